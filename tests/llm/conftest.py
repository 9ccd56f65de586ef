import pytest

#: Texts that every operator has to take: null, empty, blank, ties, repeats, odd characters, long.
ODD = [
    (1, None), (2, ""), (3, " \t\r\n"), (4, "One two, three. One two three!"), (5, "One two, three. One two three!"), (6, "é" * 3 + "́  x\x1cy\x85z ß İ"),
    (7, "a\U0001f600b <|endoftext|> x<|startoftext|>y"), (8, "word " * 6000), (9, "z" * 30000), (10, "don't they'll I'M 123 4567"), (11, "mail a.b@c.de, call +49 (30) 123-4567"), (11, "mail a.b@c.de, call +49 (30) 123-4567"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, with an extra column whose name operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", -1, "clash") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, ids string")


#: Every name that an operator uses inside, and names that need quotes.
INSIDE = """_row _slot _salt _hot _digest _base _terms _doc _hit _metadata batch digest content locator n_points row at term entity keys items n id key copies leader
component class_id rep_id kept keep_id held_out score label tuning h ids media n_bytes error words spans doc.text a.b c`d""".split()


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd texts beside columns with all names that operators use inside."""
    return odd.drop("ids").selectExpr("*", *[f"concat('{k}-', doc_id) AS `{name.replace('`', '``')}`" for k, name in enumerate(INSIDE)])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
