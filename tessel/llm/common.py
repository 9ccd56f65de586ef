"""Shared plumbing of the training-data operators: inputs, scratch tables, tokenizer memo."""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
import tempfile
import uuid
from itertools import chain, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}
_made: list[str] = []  # scratch paths of this driver, in order
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode (tests, a laptop), where the session names none, a folder of our own is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="tessel-")
        spark.sparkContext.setCheckpointDir(_own_root[app])
    return _own_root[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _made.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many scratch paths there have been: a mark for ``discard``."""
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Remove the scratch tables made since a mark, but for the last ``keep``; nothing may read them any more."""
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(columns: list[str], name: str) -> str:
    """``name``, made longer until it is none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[F.Column]:
    """Columns by their names as they are, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``text`` (null counts as empty) and the columns named in ``keep``; others go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)


SLOTS = 1 << 20


def _slots(rows: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame, str]:
    """``rows`` with the slot of ``name`` in one more column, the different slots of ``keys``, and that column's name."""
    slot, hashed = spare(rows.columns, "_slot"), F.pmod(F.xxhash64(name), F.lit(SLOTS))
    return rows.withColumn(slot, hashed), F.broadcast(keys.select(hashed.alias(slot)).distinct()), slot


def likely(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Those ``rows`` whose column ``name`` hashes to a slot in which one of ``keys`` lies.

    A superset of a semi join that moves no row: there are ``SLOTS`` slots at most, so their list
    can go to every task. An exact join follows where it matters. With many more keys than slots
    nearly all rows pass.
    """
    marked, few, slot = _slots(rows, keys, name)
    return marked.join(few, slot, "left_semi").drop(slot)


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``rows`` but for those whose column ``name`` is in ``gone``; only rows in a slot of ``gone`` move."""
    marked, few, slot = _slots(rows, gone, name)
    rest = marked.join(few, slot, "left_semi").join(gone.select(name).hint("merge"), name, "left_anti")
    return marked.join(few, slot, "left_anti").unionByName(rest).select(*named(rows.columns))


HOT_KEYS, HOT_ROWS, SALTS = 1000, 10_000, 64


def spread_join(rows: DataFrame, table: DataFrame, key: str, other: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key`` with a ``table`` that has one row a key.

    The ``HOT_KEYS`` keys with most rows (``HOT_ROWS`` at least; ``counts`` has key and n, if known)
    are dealt over ``SALTS`` parts by the column ``other`` (and, as it may be null, by partition), and
    their row of the table goes to each.
    """
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    keys = n.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key)
    found = keys.collect()
    if not found:
        return rows.join(table, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, keys.schema).withColumn("_hot", F.lit(True)))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(other, F.spark_partition_id()), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def public_tokenizer(name: str) -> str:
    """Where a public vocabulary lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def strings(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings between ``begins`` and ``ends``, which don't overlap, as an Arrow column."""
    if not len(begins):
        return pa.array([], pa.binary())
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[begins] = 1
    inside[ends] -= 1
    body = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(ends - begins, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def eights(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place ``at`` on as one number, the first one lowest; 0 behind the end."""
    full = np.append(raw, np.zeros(8, np.uint8))
    return np.lib.stride_tricks.as_strided(full, (len(raw), 8), (1, 1))[at].view("<u8").ravel().astype(np.uint64)


ONLY = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def distinct(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The different byte strings between ``begins`` and ``ends``, told byte for byte, and which of them each is.

    First those of up to seven bytes, as one number of their bytes with their length on top, then longer ones.
    """
    size = ends - begins
    few = size < 8
    short, long = np.flatnonzero(few), np.flatnonzero(~few)
    which = np.empty(len(size), np.int64)
    which[short], numbers = pd.factorize(eights(raw, begins[short]) & ONLY[size[short]] | size[short].astype(np.uint64) << np.uint64(56))
    coded = strings(raw, begins[long], ends[long]).dictionary_encode()
    which[long] = coded.indices.to_numpy() + len(numbers)
    data, offsets = coded.dictionary.buffers()[2], np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].tolist()
    body = data.to_pybytes() if data else b""
    return which, numbers, [body[a:b] for a, b in pairwise(offsets)]


class WordMemo:
    """Ids of whole texts by the ``tokenizers`` library, which sees each new word once.

    The pattern of a lower-casing word-level BPE never matches across blanks, so the ids of a text
    are those of its blank-separated words in order. Numpy finds the words of a column of texts,
    Arrow's dictionary encoding tells the different ones, byte for byte, and ids of known words are
    gathered. Only the four ASCII blanks separate, because for others (U+001C, say) the library's own
    rules may differ. As the library does both itself, ASCII letters are lower-cased first, unless
    ``<|`` occurs (special tokens are told by case), and a full stop or comma between an ASCII
    letter or digit and a blank is a word of its own. New words of Latin-1 letters go to the same
    model without its normalisers and pattern, which have nothing to do on them. The memo starts
    anew when it has ``room`` words or 64 MB of them.
    """

    def __init__(self, path: str, room: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        parts = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for k in ("normalizer", "pre_tokenizer") for x in (parts[k] or {}).get("normalizers", (parts[k] or {}).get("pretokenizers", []))]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("the memo needs a lower-casing word-level vocabulary")
        blank = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blank, parts["pre_tokenizer"]["pretokenizers"][1]]}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(parts))
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for x, i in parts["model"]["vocab"].items() if x.endswith(parts["model"]["end_of_word_suffix"])]] = True
        self.small = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)
        self.kind = np.array([0 if chr(c) in " \t\n\r" else 1 if chr(c).isalnum() and c < 128 else 2 if chr(c) in ".," else 3 for c in range(256)], np.uint8)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int | bytes, int] = {}
        self.held = 0
        self.begin, self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def learn(self, names: list[int | bytes], words: list[bytes]) -> None:
        """Append the ids of new words to the memo."""
        self.held += sum(map(len, words))
        words = [x.decode() for x in words]
        letters = [k for k, x in enumerate(words) if _LETTERS(x)]
        sizes, ids = np.zeros(len(words), np.int32), []
        order = [*letters, *sorted(set(range(len(words))).difference(letters))]
        for at in range(0, len(letters), 20_000):
            part = letters[at : at + 20_000]
            got = np.array(self.bare.encode(" ".join([words[k] for k in part]).lower(), add_special_tokens=False).ids, np.uint32)
            sizes[at : at + len(part)] = np.diff(np.flatnonzero(self.last[got]), prepend=-1)
            ids.append(got)
        rest = [words[k] for k in order[len(letters) :]]
        for at in range(0, len(rest), 20_000):
            got = [x.ids for x in self.tokenizer.encode_batch_fast(rest[at : at + 20_000], add_special_tokens=False)]
            sizes[len(letters) + at : len(letters) + at + len(got)] = [*map(len, got)]
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
        ids = np.concatenate(ids)
        first = len(self.slot)
        while len(self.begin) < first + len(words):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.begin[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(words)] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip([names[k] for k in order], range(first, first + len(words)), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of an Arrow column of texts, and where those of each text end."""
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]) if len(column) and column.buffers()[2] else pa.py_buffer(b"")
        offsets = offsets - offsets[:1]
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        if b"<|" not in data.to_pybytes():
            raw = self.small[raw]
        kind, opens = self.kind[raw], np.zeros(len(raw) + 1, bool)
        opens[offsets] = True
        inside = np.append(kind > 0, False)
        first = inside.copy()
        first[1:] &= ~inside[:-1] | opens[1:]
        mark = np.flatnonzero(kind == 2)
        mark = mark[(kind[mark - 1] == 1) & ~opens[mark] & (~inside[mark + 1] | opens[mark + 1])]
        first[mark] = True
        begins = np.flatnonzero(first)
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:])) + 1
        which, short, long = distinct(raw, begins, ends)
        names = [*short.tolist(), *long]
        if len(self.slot) > self.room or self.held > 64 << 20:
            self.forget()
        slots = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slots < 0)
        if len(new):
            listed = [names[k] for k in new.tolist()]
            self.learn(listed, [x if isinstance(x, bytes) else x.to_bytes(8, "little")[: x >> 56] for x in listed])
            slots[new] = [*map(self.slot.__getitem__, listed)]
        slots = slots[which]
        size = self.size[slots]
        after = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.repeat(self.begin[slots] - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.append(0, after)[np.searchsorted(begins, offsets[1:])]


_memos: dict[str, WordMemo] = {}


def word_memo(path: str) -> WordMemo:
    """The memo of this Python worker; it lives as long as the worker does."""
    if path not in _memos:
        _memos[path] = WordMemo(path)
    return _memos[path]


def release() -> None:
    """Give freed memory back to the system: a worker stays on beside its executor after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


TEXTS = 1 << 15  # texts of one portion, at most


def portions(batch, size: int = 2 << 20):
    """Slices of an Arrow batch (columns doc_id, text) of about ``size`` bytes of text and ``TEXTS`` texts each."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).fill_null(0).to_numpy(zero_copy_only=False)
    ends = (lengths.cumsum() // size).searchsorted(range(1, int(lengths.sum()) // size + 2))
    begin = 0
    for end in sorted({*map(int, ends), *range(TEXTS, batch.num_rows, TEXTS), batch.num_rows}):
        if end > begin:
            yield batch.slice(begin, end - begin)
            begin = end
    release()
