import hashlib
import json
import os
import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.llm import chat, language_id, mixing, queries, url_rules, vector_forest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    assert names == sorted(df.columns)
    place = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(repr([r[place[n]] for n in names]) for r in want.fetchall()) == sorted(repr([r[n] for n in names]) for r in df.collect())


# Chat formatting.


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_formatting_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "~1~0~2~3 ~", "", None, "line\n\n  \U0001f600", "[<~"]
    rows = [(1, i, "assistant" if i % 2 else "user\n<", t) for i, t in enumerate(texts)] + [(None, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")]
    made = chat.format_turns(chat.turns_of_rows(conversation(spark, rows).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(1))))
    out = {r.conv_id: r for r in made.select("conv_id", "turns", "formatted", chat.parse_formatted(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert all(r.turns == r.read for r in out.values())
    assert out[1].loss == "".join(t or "" for t in texts[1::2]) and [t.text for t in out[2].turns] == ["a", "a", "b"]
    assert [tuple(t) for t in out[None].turns] == [("", "")]
    body = out[1].formatted.replace(chat.TURN, "").replace(chat.END, "")
    assert not any(c in body for c in chat.CONTROL)


def test_formatting_edges(spark):
    assert chat.format_turns(chat.turns_of_rows(conversation(spark, []))).count() == 0
    with pytest.raises(ValueError):
        chat.turns_of_rows(spark.createDataFrame([(1,)], "x int"))


def test_row_layout_by_schema_fingerprint(spark):
    plain, rich = chat.Layout(("role", "text"), role="role", text="text"), chat.Layout(("role", "text", "edited"), role="role", text="edited")
    rows = spark.createDataFrame([(1, 1, "user", "was", "now")], "conv_id long, turn int, role string, text string, edited string")
    assert chat.turns_of_rows(rows, layouts=(plain, rich)).first().turns[0].text == "now"
    assert chat.turns_of_rows(rows).first().turns[0].text == "was"
    assert chat.turns_of_rows(rows.drop("edited"), layouts=(plain, rich)).first().turns[0].text == "was"
    with pytest.raises(ValueError, match="no row layout"):
        chat.turns_of_rows(rows.drop("role"))


def test_rows_of_unlike_shape_take_their_own_layouts(spark):
    plain, rated = chat.Layout(("role", "text", "meta"), role="role", text="text"), chat.Layout(("role", "text", "meta.better"), role="text", text="role")
    rows = spark.createDataFrame([(1, 1, "user", "a", None), (1, 2, "b", "assistant", ("x",))], "conv_id long, turn int, role string, text string, meta struct<better: string>")
    assert [tuple(t) for t in chat.turns_of_rows(rows, layouts=(plain, rated)).first().turns] == [("user", "a"), ("assistant", "b")]
    assert [tuple(t) for t in chat.turns_of_rows(rows, layouts=(plain,)).first().turns] == [("user", "a"), ("", "")]


def test_every_nested_path_counts(spark):
    records = ['{"messages": [{"role": "user", "content": "a"}]}', '{"messages": [{"role": "user", "content": "a", "name": "x"}]}', '{"messages": [{"role": "u", "content": null}, {"content": 1.5, "role": true}]}', '{"a": {"b c": {"d": [[{"e": 1}]]}}, "STRING": 2}', '{"messages": []}']
    out = [r.f for r in spark.createDataFrame([(r,) for r in records], "r string").coalesce(1).select(chat.record_fingerprint(F.col("r")).alias("f")).collect()]
    assert out[0] == out[2] == chat.LAYOUTS[1].fingerprint and len(set(out)) == 4
    assert out[1] == chat.paths_fingerprint(["messages[].role", "messages[].content", "messages[].name"])
    assert out[3] == chat.paths_fingerprint(["a.b c.d[][].e", "STRING"])


def test_long_conversations(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("<[~x"), 200).alias("text")).withColumnRenamed("id", "turn")
    one = conversation(spark, [(2, 1, "assistant", "<|end|>" * 500_000)])
    made = chat.format_turns(chat.turns_of_rows(rows.unionByName(one)))
    out = {r.conv_id: r for r in made.select("conv_id", F.size(chat.parse_formatted(F.col("formatted"))).alias("n"), F.char_length(chat.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("loss")).collect()}
    assert (out[1].n, out[1].loss) == (3000, 1500 * 800) and (out[2].n, out[2].loss) == (1, 3_500_000)


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"instruction": "a", "output": "b"},
        {"instruction": "a", "input": "", "output": "b"}, {"prompt": "a", "completion": "b"}, {"prompt": "a", "response": "b"}, {"system": "s", "prompt": "a", "response": "b"}, {"prompt": "a", "answer": "b"},
    ]
    rows = [(json.dumps(r),) for r in records] + [("not json",), (None,), ("[1]",)]
    out = chat.turns_of_records(spark.createDataFrame(rows, "record string").withColumn("TURNS", F.lit(0)), "record").collect()
    want = [[("user", "a"), ("assistant", "")], [("user", "a"), ("assistant", "b")], *[[("user", "a"), ("assistant", "b")]] * 4, [("system", "s"), ("user", "a"), ("assistant", "b")]]
    assert [[tuple(t) for t in r.turns] for r in out[:7]] == want
    assert out[7].turns is None and out[7].schema_fingerprint is not None and [r.turns for r in out[8:]] == [None] * 3 and out[9].schema_fingerprint is None
    assert out[0].schema_fingerprint == chat.LAYOUTS[1].fingerprint


# Mixing.


def test_mixing_hits_its_targets(spark, make):
    rows = [(i, f"t{i}", "aa", "big" if i % 3 else "small") for i in range(3000)]
    out, copy, rate = mixing.poisson_mix(make(rows), {"big": 1.0, "small": 3.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 750) < 110 and abs(n["small"] - 2250) < 190
    again = mixing.poisson_mix(make(rows).repartition(7), {"big": 1.0, "small": 3.0})[0]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    heavy = mixing.poisson_mix(make([(i, "x", "aa", "s") for i in range(400)]), total=400 * 50.0, seed=3)[0].groupBy("doc_id").count().toPandas()["count"]
    assert abs(heavy.mean() - 50) < 1.5 and abs(heavy.var() - 50) < 12


def test_a_tiny_source_is_dealt_out(spark, make):
    rows = [(1, "x" * 100_000, "aa", "tiny"), (2, "y", "aa", "tiny")] + [(i, "z", "aa", "big") for i in range(10, 3010)]
    out, copy, _ = mixing.poisson_mix(make(rows))
    n = {r.doc_id: (r["count"], r.low, r.high, r.kinds) for r in out.where("source = 'tiny'").groupBy("doc_id").agg(F.count("*").alias("count"), F.min(copy).alias("low"), F.max(copy).alias("high"), F.count_distinct(copy).alias("kinds")).collect()}
    assert sum(k for k, *_ in n.values()) == pytest.approx(1501, abs=160)
    assert all(low == 1 and high == kinds == k for k, low, high, kinds in n.values())


def test_mixing_edges(spark, make, none, corpus):
    assert mixing.poisson_mix(none)[0].count() == 0
    docs = make([(None, None, None, None), (None, None, None, None), (1, "", "aa", "s")]).withColumn("COPY_NO", F.lit("x"))
    out, copy, rate = mixing.poisson_mix(docs, total=300)
    assert copy == "copy_no_" and out.columns == [*docs.columns, rate, copy]
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {None, "s"} and n[None] % 2 == 0
    assert mixing.poisson_mix(make(corpus), {})[0].count() == 0
    assert {r.source for r in mixing.poisson_mix(make(corpus), {"s1": 2.0})[0].select("source").distinct().collect()} == {"s1"}


# URLs.


def verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:end].translate(brute.LOWER), rest[end:].split("?")[0].split("#")[0]
    best = None
    for r in queries.URL_RULES:
        h, _, p = r.rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.rule) > len(best.rule)):
            best = r
    return host, path, best.rule if best else None, best.verdict if best else None


URLS = ["http://A.Example.NET/en/1?x=/de/#/", "https://example.com/de/2", "http://sub.example.com/de/", "http://org/fr/x", "http://x.org/fr", "http://xorg/fr/", "http://net", "http://net/", "http://net?a/", None, "", "no scheme/en/", "a://b://c.net/y", "http://ÉÀ.NET/\n/q", "http://example.net/en/", "http://.net/z"]


def test_rules_decide_first(spark):
    urls = URLS + [f"http://{s}.example.com/{p}/{i}" for i, (s, p) in enumerate([("shop", "de"), ("news", "en"), ("shop", "de"), ("news", "fr")] * 10)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("verdict", F.lit(1)).withColumn("items", F.lit(2))
    out = {r.page_id: r for r in url_rules.judge_urls(pages, queries.URL_RULES).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, word = verdict(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == word if rule else out[i].verdict in ("allow", "block")


def test_mined_rules_match_by_their_items(spark):
    labelled = spark.createDataFrame([(["h:bad", "p:x"], "block")] * 30 + [(["h:good", "p:x"], "allow")] * 30 + [(["h:bad", "p:ok"], "allow")] * 10, "items array<string>, label string")
    rules = url_rules.mine_rules(labelled, 0.05, 0.9)
    kept = {(tuple(r["items"]), r.label) for r in rules.collect()}
    assert (("h:bad", "p:x"), "block") in kept and (("h:good",), "allow") in kept and (("h:good", "p:x"), "allow") not in kept
    urls = spark.createDataFrame([(1, ["p:x", "h:bad", "p:new"]), (2, ["h:good"]), (3, ["p:x"]), (4, [])], "k long, items array<string>")
    assert {r.k: r.label for r in url_rules.match_rules(urls, rules, "k").collect()} == {1: "block", 2: "allow"}


def plain_verdicts(urls, min_support=0.005, min_confidence=0.8):
    """Rules mined by enumeration of all item sets, pruned, and matched one by one. Sums and shares are exact in both."""
    import itertools
    import math
    import re

    def items(url):
        host, path = verdict(url)[:2]
        rest = (url or "").split("://", 1)[-1] if "://" in (url or "") else (url or "")
        query = rest.split("#")[0].partition("?")[2]
        out = ["h:" + x for x in host.split(".")] + ["p:" + re.sub(r"\d+", "0", x) for x in re.split("[^a-z0-9]+", path.translate(brute.LOWER))] + ["q:" + x.partition("=")[0] for x in query.split("&")]
        return frozenset(x for x in out if len(x) > 2)

    told = [(items(u), *verdict(u)[2:]) for u in urls]
    labelled = [(x, v) for x, r, v in told if r]
    least = math.ceil(min_support * len(labelled))
    n, by = {}, {}
    for x, v in labelled:
        for k in range(1, len(x) + 1):
            for c in itertools.combinations(sorted(x), k):
                n[c] = n.get(c, 0) + 1
                by[c, v] = by.get((c, v), 0) + 1
    rules = {(c, v): (m / n[c], m / len(labelled)) for (c, v), m in by.items() if m >= least and m / n[c] >= min_confidence}
    kept = {(c, v): x for (c, v), x in rules.items() if not any(rules.get((d, v), (0,))[0] >= x[0] for k in range(1, len(c)) for d in itertools.combinations(c, k))}
    out = []
    for x, r, v in told:
        met = [(figures, label) for (c, label), figures in kept.items() if x.issuperset(c)]
        out.append({v} if r else {label for figures, label in met if figures == max(met)[0]} or {"allow"})
    return out


def test_mined_verdicts_equal_plain_mining(spark):
    rng = random.Random(31)
    urls = [f"https://{rng.choice(['shop', 'news', 'www', 'a.b'])}.{rng.choice(['example.com', 'example.net', 'x.net', 'y.org', 'z.io', 'w.org'])}/{rng.choice(['de', 'en', 'fr', 'it'])}/{rng.choice(['buy', 'read', 'ad'])}/{rng.randint(1, 99)}{rng.choice(['', '?id=3', '?ref=1&ad=2'])}" for _ in range(220)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, queries.URL_RULES).collect()}
    want = plain_verdicts(urls)
    assert all(out[i] in w for i, w in enumerate(want))
    assert sum(len(w) == 1 for w in want) > 180 and len({next(iter(w)) for w in want}) == 2


def test_long_urls_do_not_widen_mining(spark):
    common = "/".join(f"part{chr(97 + i)}" for i in range(26))
    urls = [f"https://h{i % 3}.example.com/de/{common}/{i}" for i in range(60)] + [f"https://other.io/{common}/{i}" for i in range(5)] + ["https://x.io/" + "y/" * 50_000, f"https://other.io/{common}?" + "q=1&" * 20_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = [r.verdict for r in url_rules.judge_urls(pages, queries.URL_RULES).orderBy("page_id").collect()]
    assert out[:65] == ["block"] * 65 and out[65] == "allow" and out[66] == "block"


def test_equal_rules_go_to_the_last_label(spark):
    rules = spark.createDataFrame([(["a"], "allow", 0.9, 0.5), (["b"], "block", 0.9, 0.5)], "items array<string>, label string, confidence double, support double")
    assert url_rules.match_rules(spark.createDataFrame([(1, ["a", "b"])], "k long, items array<string>"), rules, "k").first().label == "block"


def test_url_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(empty, queries.URL_RULES).count() == 0
    unlabelled = spark.createDataFrame([(None, "http://x.com/a"), (1, "http://x.com/a"), (1, "http://x.com/a")], "page_id long, url string")
    assert [r.verdict for r in url_rules.judge_urls(unlabelled, queries.URL_RULES).collect()] == ["allow"] * 3


# Vectors.


def exact(ids, x, queries_, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries_:
        s = u @ u[ids.index(q)]
        order = sorted((i for i in ids if i != q), key=lambda i: (-round(float(s[ids.index(i)]), 12), i))[:k]
        out[q] = [(i, float(s[ids.index(i)])) for i in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)]
    x[100:140] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_forest.nearest(table, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    want = exact(list(range(3000)), x, range(0, 3000, 50))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [k for k, _, _ in rows] == [1, 2, 3, 4, 5]
        hits += len({i for _, i, _ in rows} & {i for i, _ in want[q]})
        for _, i, s in rows:
            assert s == pytest.approx(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i]), abs=1e-12)
    assert hits / (5 * len(want)) >= 0.9
    assert [i for _, i, _ in got[100]] == [0, 101, 102, 103, 104] and [i for _, i, _ in got[0]] == [100, 101, 102, 103, 104]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_the_table_with_the_shipped_bound(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).toPandas()
    x = np.stack(rows["v"].to_numpy())
    ids = rows["vec_id"].tolist()
    asked = [i for i in ids if i % 50 == 0]
    want = exact(ids, x, asked)
    got = {}
    for r in vector_forest.nearest(table, F.col("id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    recall = sum(len(got[q] & {i for i, _ in want[q]}) for q in asked) / (5 * len(asked))
    print("recall", recall)
    assert recall >= 0.9


def test_bound_follows_the_clusters():
    rng = np.random.default_rng(17)
    loose = rng.normal(size=(2000, 16))
    tight = 0.02 * rng.normal(size=(2000, 16)) + rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)]
    share = []
    for x in (vector_forest.unit_rows(loose), vector_forest.unit_rows(tight)):
        trees = [vector_forest.grow(x, 45.0, rng) for _ in range(4)]
        bound = vector_forest.fitted_bound(trees, x, 5, 0.95)
        share.append(np.mean([len(vector_forest.search_leaves(trees, q, bound)) for q in x[:100]]) / sum(len(t.offset) + 1 for t in trees))
        gaps = vector_forest.leaf_gaps(trees[0], x[:5])
        assert all(sorted(np.flatnonzero(g <= bound).tolist()) == sorted(leaf for _, leaf in vector_forest.search_leaves(trees[:1], q, bound)) for g, q in zip(gaps, x[:5], strict=True))
    assert share[1] < 0.2 * share[0]


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1e200, 1e200]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1e200, 1e200])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    out = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in vector_forest.nearest(table, F.col("id") % 50 == 0).collect())
    half = round(0.5**0.5, 9)
    assert out == [(0, 1, 1, half), (0, 2, 50, 0.0), (50, 1, 1, half), (50, 2, 0, 0.0)]
    assert vector_forest.nearest(table.limit(0), F.col("id") % 50 == 0).count() == 0


# The pipeline.


def test_pipeline_stages(spark, corpus, corpus_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    columns = docs.columns
    seen = {"documents": docs.count()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, corpus_dir)
        assert out.columns == columns or k == len(pipeline.STAGES) - 1
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.count()
        if name == "language_id":
            gone = {r.doc_id for r in before.join(docs, "doc_id", "left_anti").collect()}
            assert {90, 91, 92, 97} <= gone and len(gone) < 10
        if name == "simhash_near_dedup":
            left = {r.doc_id for r in docs.collect()}
            assert not left & set(range(60, 75)) and len(left & set(range(75, 90))) <= 1
        if name == "substring_dedup":
            want = brute.substring_dedup([(r.doc_id, r.text) for r in before.collect()])
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert set(texts) == {i for i, (n, _, kept) in want.items() if kept or not n}
            assert all(texts[i] == kept for i, (_, gone, kept) in want.items() if gone and kept)
    whole = pipeline.run(spark, corpus_dir)
    assert whole.count() == seen["sentencepiece"] == seen["poisson_mixing"] and pipeline.ORACLE_SQL is None
    none = docs.limit(0)
    empty = spark.createDataFrame([], spark.read.parquet(f"{corpus_dir}/documents.parquet").schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, corpus_dir).count() == 0
    assert none.count() == 0


def test_mixed_and_short_documents_stay(spark, make):
    pipeline = pytest.importorskip("corpus_pipeline")
    tongues = ["abcdefgh", "ijklmnop", "qrstuvwx"]
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    rows = [(i, " ".join(word(tongues[i % 3]) for _ in range(40)), f"l{i % 3}", "s") for i in range(30)]
    mixed = " ".join(word(letters) for letters, n in zip(tongues, (45, 40, 15), strict=True) for _ in range(n))
    docs = make([*rows, (100, mixed, None, "s"), (101, "a i q", None, "s"), (102, "12 34", None, "s")])
    found = {r.doc_id: r for r in language_id.label(docs, language_id.train(docs)).collect()}
    assert len(found[100].lang_spans) == 3 and found[100].lang_score < 0.5 and found[101].lang_score < 0.5
    left = {r.doc_id for r in pipeline.keep_known_languages(spark, docs, "").collect()}
    assert left == {*range(30), 100, 101}


def test_columns_named_like_the_operators_own_stay(spark, make, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = make(corpus[:20]).withColumn("lang_pred", F.lit("mine")).withColumn("LANG_SCORE", F.lit(7)).withColumn("_text_id", F.lit("t")).withColumn("uid", F.lit("u")).withColumn("copy_no", F.lit("c"))
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {(r["lang_pred"], r["LANG_SCORE"], r["_text_id"], r["uid"], r["copy_no"]) for r in out.collect()} == {("mine", 7, "t", "u", "c")}


def test_digest_of_kept_words_is_of_utf8():
    assert hashlib.sha256("é".encode()).hexdigest() == duckdb.execute("SELECT sha256('é')").fetchone()[0]
