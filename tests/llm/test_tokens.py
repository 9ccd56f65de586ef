import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessel.llm import byte_bpe, packing, queries, token_files
from tessel.llm.common import WordMemo, scratch

from .conftest import ODD

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(WORDS)


def library_ids(text, end):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def morse(n, letters="ab"):
    """A word that polynomial hashes modulo 2**64 can't tell from its complement."""
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_words_are_told_byte_for_byte(spark):
    texts = {1: morse(2048), 2: morse(2048, "ba"), 3: f"{morse(1024)} {morse(1024, 'ba')}"}
    docs, path = spark.createDataFrame([*texts.items()], "doc_id long, text string"), scratch(spark, "t")
    check_packing(packing.pack_documents(docs, WORDS, 1).collect(), texts, 4096)
    token_files.write_token_files(docs, path, WORDS, 2)
    assert {r["doc_id"]: bytes(r["ids"]) for r in token_files.read_token_files(spark, path).collect()} == {k: library_ids(t, 2) for k, t in texts.items()}


def test_memo_equals_the_library():
    texts = [t or "" for _, t in ODD] + ["Word word. WORD, Wörter. Wörter x.. 'S. it's. <|ENDOFTEXT|> <|endoftext|>. ., . é, é. 5. ٣. 中."]
    texts += [*map(morse, (1024, 2048)), *(morse(n, "ba") for n in (1024, 2048)), *("x" * n for n in range(6, 10))]
    memo = WordMemo(WORDS, room=5)
    for _ in range(2):
        for column in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts))):
            ids, ends = memo.encode(column)
            assert [np.append(x, 2).astype("<u4").tobytes() for x in np.split(ids, ends[:-1])] == [library_ids(t, 2) for t in texts]
    assert [len(x) for x in memo.encode(pa.array([], pa.string()))] == [0, 0]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n) >> rng.choice([0, 8, 16, 24, 31], n)).astype(np.uint32)
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(control, data, n) == values).all()


def test_op9_equals_brute_force(spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_token_files(spark, SF).collect()}
    start, want = 0, {}
    for doc_id, text in sorted(texts_of(spark).items()):
        ids = library_ids(text, 2)
        want[doc_id] = (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert got == want


def test_op9_odd(spark, odd, none):
    path = scratch(spark, "t")
    token_files.write_token_files(odd, path, WORDS, 2)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [i for i, _ in ODD]
    assert [bytes(r["ids"]) for r in rows] == [library_ids(t, 2) for _, t in ODD]
    path = scratch(spark, "t")
    token_files.write_token_files(none, path, WORDS, 2)
    assert token_files.read_token_files(spark, path).count() == 0


def check_packing(rows, text_of, capacity):
    pieces, spaces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        spaces[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in text_of.items():
        ids, at = library_ids(text, 1), 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r["piece"])):
            own = ids[4 * at : 4 * at + 4 * capacity]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, at, len(own) // 4, zlib.crc32(own))
            at += len(own) // 4
        assert at == len(ids) // 4
    for places in spaces.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spaces)


def test_op8_packs_all_and_tightly(spark):
    rows = queries.op8_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, texts_of(spark), 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_op8_odd(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 4)
    one_each = odd.dropDuplicates(["doc_id"])
    rows = packing.pack_documents(one_each, WORDS, 1, 64).collect()
    check_packing(rows, dict(ODD), 64)
    assert packing.pack_documents(odd, WORDS, 1, 64).where("doc_id = 11").count() == 2
    assert packing.pack_documents(none, WORDS, 1, 64).count() == 0


def test_op8_long_pieces_keep_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 4)
    sizes, own = [], packing.pack_level
    monkeypatch.setattr(packing, "pack_level", lambda items, shards, *more: sizes.append((items.count(), shards)) or own(items, shards, *more))
    texts = {k: "word " * 40 for k in range(64)}
    rows = packing.pack_documents(spark.createDataFrame([*texts.items()], "doc_id long, text string"), WORDS, 1, 64).collect()
    assert check_packing(rows, texts, 64) == 64
    assert all(n <= 4 * shards for n, shards in sizes)


def test_op8_pools_until_nothing_is_saved(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 2)
    levels = []

    def pack_level(items, shards, capacity, level):
        levels.append(level)  # each level joins two rows of one sequence more, and none from the seventh on
        rows = sorted((r["row"], r["length"]) for r in items.collect())
        at = [(0, 0) if k and level < 6 and k <= level + 1 else (k, 0) for k in range(len(rows))]
        out, used = [], {}
        for (row, length), (group, _) in zip(rows, at, strict=True):
            out.append((row, length, rows[group][0], used.get(group, 0)))
            used[group] = used.get(group, 0) + length
        return spark.createDataFrame([(*x, 1) for x in out], "row long, length long, sequence_id long, offset long, fill long")

    monkeypatch.setattr(packing, "pack_level", pack_level)
    texts = {k: "word " * 3 for k in range(12)}
    rows = packing.pack_documents(spark.createDataFrame([*texts.items()], "doc_id long, text string"), WORDS, 1, 64).collect()
    assert check_packing(rows, texts, 64) == 12 - 6
    assert levels == [*range(7)]


def test_op8_large_shards_have_ids_of_their_own(spark):
    items = spark.range(140_000).select(F.col("id").alias("row"), F.lit(1).cast("long").alias("length"))
    assert packing.pack_level(items, 2, 1).select("sequence_id").distinct().count() == 140_000


def test_crossover_beats_or_keeps_best_fit():
    rng = np.random.default_rng(0)
    length = rng.integers(900, 2100, 400)
    first = packing.first_groups(length, 4096, 1)
    best = packing.evolve(length, first, 4096, 1)[0]
    assert packing.fitness(length, best, 4096) > packing.fitness(length, first[0], 4096)
    assert np.bincount(best, length).max() <= 4096 and len(best) == 400


def tiktoken_of():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_op10_equals_tiktoken(spark):
    own = tiktoken_of()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_byte_bpe(spark, SF).collect()}
    for doc_id, text in texts_of(spark).items():
        ids = np.array(own.encode_ordinary(text or ""), "<u4")
        assert got[doc_id] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_op10_odd(spark, odd, none):
    own, path = tiktoken_of(), P.path("byte_bpe_50k.tiktoken")
    more = odd.unionByName(spark.createDataFrame([(90, "\x1c \x1d\x85 ᠎​  x  y"), (91, "ab" * 20000), (92, "".join(chr(97 + i * i % 23) for i in range(3000)))], "doc_id long, text string"), allowMissingColumns=True)
    rows = byte_bpe.decode_bytes(byte_bpe.encode_bytes(more, path, P.PATTERN), path, P.PATTERN).join(more.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_bpe.encode_bytes(none, path, P.PATTERN).count() == 0


def test_op10_long_words():
    own, rng = tiktoken_of(), np.random.default_rng(3)
    bpe = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    words = [(part * 9000)[:9000] for part in (b"a", b"ab", b"the", b"aing", b"er", b"abcabd", b"=", b"\xff")]
    for letters in (b"ab", b"acgt", b"ethanoirs", bytes(range(97, 123)), bytes(range(256))):
        words += [bytes(np.frombuffer(letters, np.uint8)[rng.integers(0, len(letters), n)]) for n in (1, 2, 65, 66, 67, 300, 300, 4000)]
    words.sort(key=len)
    for word, ids in zip(words, bpe.contract(words), strict=True):
        assert ids.tolist() == own._core_bpe.encode_single_piece(word)


def test_op10_both_forms_agree(monkeypatch):
    rng = np.random.default_rng(4)
    bpe = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    words = [bytes(rng.choice(np.frombuffer(b"ethanoirsd", np.uint8), n)) for n in rng.integers(1, 65, 3000)]
    short = bpe.contract(words)
    monkeypatch.setattr(byte_bpe, "LONG", 0)
    assert [x.tolist() for x in bpe.contract(words)] == [x.tolist() for x in short]
