import pytest

from goldsieve.llm.common import stored  # noqa: F401  (the folder is tested only with the subpackage)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows, over several partitions."""

    def make(rows, extra=""):
        full = [(r + (None,) * (4 - len(r)))[:4] + (len(r[1] or ""),) + (("x",) * extra.count(" string")) for r in map(tuple, rows)]
        return spark.createDataFrame(full, SCHEMA + extra).repartition(3)

    return make


EDGE = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "One two"), (None, "one"), (None, None), (7, "é ñ ß 漢字 𝒳"), (8, "same line\nsame line\nsame line"),
    (9, "a b c d e f g h i j k l"), (9, "a b c d e f g h i j k l"), (10, "word " * 60_000), (11, "x" * 300_000), (12, "### *** %%%"), (13, "\x00\x1c\x85"),
]


@pytest.fixture
def edge(docs):
    return docs(EDGE)


@pytest.fixture
def clashing(docs):
    """Columns with names that operators use inside or add."""
    names = "id body tie hot head slice row place line words key print size shard slot kept score held_out lang_pred n_lines ids start best hash first "
    names += "_hash _id _of _drops _key _slice _base _whole _part _shard _piece _row _text _ids body drops of_id of_hash fingerprint component who conv"
    names = list(dict.fromkeys(names.split()))
    return docs(EDGE, extra="".join(f", `{n}` string" for n in names))
