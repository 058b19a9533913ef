import random

import pytest

SF = "/root/testdata/sf0.001"


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


#: documents with nulls, empty and long texts, copies, near copies, shared passages and repeated rows
PASSAGE = " ".join(words(70, 99))
BASE = words(300, 1)


def odd_texts():
    near = BASE[:]
    near[150] = "changed"
    far = [w if i % 4 else f"x{i}" for i, w in enumerate(BASE)]
    return [
        (1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join(near)), (4, " ".join(far)),
        (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "ONE"), (10, "one two three"),
        (11, "Start " + PASSAGE + " end of eleven"), (12, "Another beginning, " + PASSAGE + "\nand more words"),
        (13, " ".join(words(20_000, 5))), (14, " ".join(words(20_000, 5)[:19_990])),
        (15, "é É × ÷ —   　 日本 🙂 don't I'LL <|endoftext|> [INST] a\\b"),
        (16, "a" * 5000), (17, "same line\n" * 200), (17, "same line\n" * 200), (18, " ".join(words(60, 7))),
        (18, PASSAGE), (19, "0" * 3000 + " 1.2.3.4 x@y.z"), (None, " ".join(BASE)), (None, "one"),
        (20, " ".join(words(49, 8))), (21, " ".join(words(49, 8))), (22, " ".join(words(50, 9))), (23, " ".join(words(50, 9))),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i and i % 3 else None, "s", -1, "node", 7, "k", "sc", [1]) for i, t in odd_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "node string, a long, kind string, score string, extra array<int>").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def con():
    import duckdb
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def view(con, name, rows, columns):
    """Replaces a view by literal rows."""
    import duckdb
    c = duckdb.connect()
    c.execute(f"CREATE TABLE {name} ({columns})")
    if rows:
        c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return c


def table_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def sql_table(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cur.fetchall()), key=repr)
