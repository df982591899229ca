import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Texts that are hard for one operator or another; ids tie and rows repeat.
HARD = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "One two three é ß"), (5, "MIT License mit license apache LICENSE"),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (7, "a b c d e f g h i j k l m n o p q r s t u v w x y Z"),
    (7, "a b c d e f g h i j k l m n o p q r s t u v w x y Z"), (8, "mail me.at@x.example.com or +1 (415) 555-1234, 10.0.0.1 card 4539 1488 0343 6467."),
    (9, "word " * 30000), (10, "x" * 100000), (11, "\U0001f600 不 ́ é"), (12, "7" * 3000), (13, "general public license " * 40),
    (14, "the general  public-license; the GNU general public license version 3"),
]


def row_set(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="session")
def hard(spark):
    """With columns whose names clash with what operators make."""
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", i, "x", 1.0, [1], "y") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, ids array<int>, mix_slot string")


@pytest.fixture(scope="session")
def none(spark, hard):
    return spark.createDataFrame([], hard.schema)


def oracle(sql, sf=None, **frames):
    """Rows of DuckDB SQL over the test tables, or over given pandas frames, with columns by name."""
    con = duckdb.connect()
    for t in TABLES if sf else ():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, frame in frames.items():
        con.register(name, frame)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in r.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())


def _plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
