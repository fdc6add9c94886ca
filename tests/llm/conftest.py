import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed, letters, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source): two languages, copies, near copies, shared passages, blanks, a null and one very long text."""
    rng = random.Random(3)
    tongues = {"aa": vocabulary(1, "abcdefgh"), "bb": vocabulary(2, "mnopqrstu")}
    text = lambda lang, n: " ".join(rng.choices(tongues[lang], k=n))
    passage = {k: text(k, 60) for k in tongues}
    rows = []
    for i in range(60):
        lang = "aa" if i % 3 else "bb"
        body = text(lang, rng.randint(5, 120))
        if i % 10 == 4:
            body = f"{text(lang, 20)} {passage[lang]} {text(lang, 9)}"
        rows.append([i, body, lang, f"s{i % 3}"])
    for i in range(60, 75):
        rows.append([i, rows[i - 60][1], rows[i - 60][2], "s0"])
    for i in range(75, 90):
        w = rows[24][1].split(" ")
        w[i - 75] = "changed"
        rows.append([i, " ".join(w), rows[24][2], "s0"])
    long = text("aa", 20000)
    rows += [[90, "", "aa", "s1"], [91, None, None, None], [92, " \t\n ", "bb", "s1"], [93, "Word", "aa", "s2"], [94, long, "aa", "s2"], [95, "中文 \U0001f600 é <s>[INST]~1", "bb", "s2"], [96, rows[24][1].upper(), None, "s2"], [97, "12 34 !!", "aa", None]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def corpus_dir(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    frame(spark, corpus).repartition(3).write.parquet(f"{path}/documents.parquet")
    return f"file://{path}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k, s, None if t is None else len(t)) for i, t, k, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    """An empty table."""
    return spark.createDataFrame([], SCHEMA)
