"""Operators against literal vectors and plain Python versions."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import chunking, matching, ordered, retrieval, scoring, state, verify, views
from factloom.sources import readers, store
from factloom.streaming import progress


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_normalisers_differ(spark):
    raw = "“Wheat—Exports” fell\n by 3.5 %"
    assert one(spark, T.normalize_quote("t"), t=raw) == '"wheat-exports" fell by 3.5 %'
    assert one(spark, T.normalize_ascii("t"), t=raw) == "wheat exports fell by 3 5"
    assert one(spark, T.normalize_title("t"), t="Caf&amp;é <i>und</i> 食料_援助") == "caf é und 食料 援助"


def test_years_and_stamps(spark):
    assert one(spark, T.year_of("t"), t="issued 12019, then 1987 and 2020") == 1987
    assert one(spark, T.year_of("t"), t="no year") is None
    assert one(spark, T.evidence_query("t", "y"), t="Wheat exports fell.", y=2019) == "Wheat exports fell. 2019"
    assert one(spark, T.evidence_query("t", "y"), t="In 2019 they fell.", y=2019) == "In 2019 they fell."
    assert one(spark, T.verdict_stamp("t", 8), t="abc") == "abc:k=8"


def test_phrases(spark):
    assert one(spark, T.phrase("t"), t="The U.N. World-Bank a b c") == "the un world bank abc"
    assert one(spark, T.search_phrases("t"), t='food-aid "" Café ...') == [["food", "aid"], ["cafe"]]
    assert one(spark, T.publishers_agree("a", "b"), a="Welthungerhilfe", b="Welthungerhilfe e.V.") is True
    assert one(spark, T.publishers_agree("a", "b"), a="", b="x") is False


def test_isbn_across_forms(spark):
    assert one(spark, T.same_isbn("a", "b"), a="9290903546", b="9789290903543") is True
    assert one(spark, T.same_isbn("a", "b"), a="9290903546", b="9799290903543") is False


@pytest.mark.parametrize("spec", ["coverage:1,coverage:0", "speed:1", "coverage:x", "coverage:-1,recency:2", "coverage:nan", "coverage:0.5"])
def test_bad_weights(spec):
    with pytest.raises(ValueError):
        T.parse_weights(spec)


def test_labels(spark):
    assert one(spark, T.delta_label("a", "b"), a=0.144, b=0.156) == "+2"
    assert one(spark, T.percent_label("a"), a=0.144) == "14%"
    assert one(spark, T.error_hint("t"), t="openai.APIConnectionError: gone") == "connection"


def test_accuracy_vectors(spark):
    rows = [("r", "SUPPORTED", None)] * 3 + [("r", "CONTRADICTED", "disavowed")] * 2 + [("r", "CONTRADICTED", "asserted"), ("r", "SUPPORTED", "disavowed"), ("r", "UNVERIFIABLE", None), ("r", "UNVERIFIABLE", "disavowed")]
    rows += [("u", "UNVERIFIABLE", None)] * 4
    got = {r["run_id"]: r for r in scoring.accuracy(spark.createDataFrame(rows, "run_id string, verdict string, stance string"), "run_id").collect()}
    assert (got["r"]["correct"], got["r"]["incorrect"]) == (5, 2)
    assert got["r"]["accuracy"] == pytest.approx(5 / 7, abs=1e-4) and got["r"]["coverage"] == pytest.approx(7 / 9, abs=1e-4)
    assert got["u"]["accuracy"] is None and got["u"]["coverage"] == 0.0


def test_means(spark):
    rows = spark.createDataFrame([("a", 90.0, 3), ("a", 30.0, 1), ("b", 90.0, 0), ("b", 30.0, None)], "run string, total double, usage int")
    got = {r[0]: tuple(r)[1:] for r in scoring.usage_weighted_mean(rows, "run").collect()}
    assert got == {"a": (75.0, "usage_weighted_mean"), "b": (60.0, "unweighted_mean_no_usage")}
    years = spark.createDataFrame([("a", 2025), ("a", 2024), ("b", 2018), ("c", None)], "run string, year int")
    assert {r[0]: r[1] for r in scoring.recency_score(years, 2026, "run").collect()} == {"a": 100.0, "b": 60.0, "c": None}


def test_validity(spark):
    weights = T.parse_weights("coverage:0.2,consistency:0.2,methodology:0.3,context:0.2,recency:0.1")
    names = ["coverage", "consistency", "methodology", "context"]
    rows = [("a", n, 80.0) for n in names] + [("a", "recency", 100.0)] + [("b", n, 80.0) for n in names] + [("b", "recency", None)]
    df = spark.createDataFrame(rows, "run string, component string, score double")
    assert {r[0]: r[1] for r in scoring.validity_total(df, weights, "run").collect()} == {"a": 82.0, "b": 80.0}
    with pytest.raises(PySparkException):
        scoring.validity_total(df.where("component = 'recency' and run = 'b'"), weights, "run").collect()


def test_chunks_are_bounded_and_lossless():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * (i % 17) for i in range(40))
    parts = list(chunking.chunk_text(text, 200, 50))
    assert all(len(p) <= 200 for p in parts) and all(f"Paragraph {i}." in " ".join(parts) for i in range(40))
    assert sum(map(len, chunking.chunk_text("x" * 950, 300, 0))) == 950
    for bad in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            chunking.check_sizes(*bad)


def test_ingest_rows(spark):
    s = spark.createDataFrame([("d", 1, "Intro", 1, "One.\n\nTwo.")], "doc_id string, section_no long, title string, page int, text string")
    t = spark.createDataFrame([("d", 2, 0, "Cap", "x" * 5000), ("d", 3, 1, None, "")], "doc_id string, page int, position int, caption string, markdown string")
    f = spark.createDataFrame([("d", 4, 0, " ", None, "f1")], "doc_id string, page int, position int, caption string, description string, figure_id string")
    rows = chunking.ingest(s, t, f).collect()
    kinds = {r["kind"]: r for r in rows}
    assert sorted(kinds) == ["figure", "table", "text"] and len(rows) == 3
    assert kinds["table"]["text"].endswith("\n[table truncated]") and kinds["figure"]["text"] == "Figure on page 4" and kinds["text"]["section"] == "Intro"


def test_metadata_text(spark):
    rows = [("d", 1, 1, "Title", "a" * 3000), ("d", 2, 1, "Title", "b" * 2990), ("d", 3, 2, "Imprint", "Published by X. ISBN 1"), ("d", 4, 60, None, "Recommended citation: X")]
    got = ordered.metadata_text(spark.createDataFrame(rows, "doc_id string, id long, page int, section string, text string")).first()["text"]
    assert got.startswith("## Title\n\naaa") and got.count("## Title") == 1 and "LIKELY IMPRINT" in got
    tail = got[got.index("LIKELY") :]
    assert tail.index("Recommended citation") < tail.index("Published by")


def test_history(spark):
    rows = [(1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (1, 3, "assistant")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string")
    assert sorted(r["turn"] for r in ordered.trim_history(df, 3).collect()) == [2, 3]
    assert ordered.trim_history(df, 0).count() == 0


def quote_case(spark, verdict, quote, index, texts=("Wheat exports fell to 12 million in 2019.", "Rice “prices” rose  sharply in 2020."), year=2019):
    a = spark.createDataFrame([(1, year, verdict, quote, index)], "claim_id long, year int, verdict string, quote string, evidence_index int")
    e = spark.createDataFrame([(1, i + 1, 100 + i, t) for i, t in enumerate(texts)], "claim_id long, pos int, chunk_id long, text string")
    r = verify.check_verdicts(a, e).first()
    return r["verdict"], r["quote_verified"], r["quoted_chunk_id"], r["year_flag"]


def test_quotes(spark):
    assert quote_case(spark, "SUPPORTED", "exports fell to 12", 1) == ("SUPPORTED", 1, 100, 0)
    assert quote_case(spark, "SUPPORTED", '"prices" rose sharply', 1) == ("SUPPORTED", 1, 101, 1)
    assert quote_case(spark, "CONTRADICTED", "invented words here", 1) == ("UNVERIFIABLE", 0, None, None)
    assert quote_case(spark, "SUPPORTED", None, None) == ("UNVERIFIABLE", 0, None, None)
    assert quote_case(spark, "SUPPORTED", "2019", 1) == ("UNVERIFIABLE", 0, None, None)
    assert quote_case(spark, "UNVERIFIABLE", None, None) == ("UNVERIFIABLE", None, None, None)
    assert quote_case(spark, "UNVERIFIABLE", "exports fell to 12", 9) == ("UNVERIFIABLE", 1, 100, None)


def test_bm25_phrases_and_stats(spark):
    chunks = spark.createDataFrame([(1, "food aid in Café"), (2, "aid food"), (3, "nothing here"), (4, "more nothing"), (5, "yet more")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "food-aid"), (2, "cafe cafe"), (3, '"" ...'), (4, "cafe")], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25(chunks, q).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1)} and got[2, 1] == pytest.approx(2 * got[4, 1])


def test_knn_blocks_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 2) for i in range(80)] + [(200, [1.0] * 6, 0), (201, [2.0] * 6, 0)]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<double>, kind int")
    got = retrieval.knn(df, df.withColumnRenamed("chunk_id", "query_id"), 3, ["kind"], block_rows=7).collect()

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)

    for i, v, kind in rows:
        want = [c for _, c in sorted((-cos(v, w), c) for c, w, k in rows if k == kind)[:3]]
        assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want
    with pytest.raises(PySparkException):
        retrieval.knn(spark.createDataFrame([(1, [0.0])], "chunk_id long, vector array<double>"), df.select(F.col("chunk_id").alias("query_id"), "vector")).collect()


def test_fusion_ties(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank long")
    w = spark.createDataFrame([(1, 20, 1), (1, 11, 2)], "query_id long, chunk_id long, rank long")
    got = [(r["chunk_id"], r["channels"]) for r in retrieval.fuse(v, w, 5).orderBy("rank").collect()]
    assert got == [(11, "vector+keyword"), (10, "vector"), (20, "keyword")]


def test_greedy_pairing_takes_each_row_once(spark):
    g = spark.createDataFrame([("s", 1, "twelve percent of rice", 12.0, None), ("s", 2, "fewer than a dozen", 12.0, None), ("s", 3, "other words entirely", None, None)], "set_id string, id long, text string, value double, year int")
    r = spark.createDataFrame([("s", 1, "fewer than a dozen remained", 12.0, 2020), ("s", 2, "rice was twelve percent", 12.0, None)], "set_id string, id long, text string, value double, year int")
    c = matching.candidates(g, r)
    assert sorted(tuple(x)[1:] for x in matching.greedy_pairs(c).collect()) == [(1, 2), (2, 1)]
    assert sorted(tuple(x)[1:] for x in matching.greedy_pairs(c, best_fit=False).collect()) == [(1, 1), (2, 2)]
    s = matching.extraction_score(g, r, matching.greedy_pairs(c)).first()
    assert (s["matched"], s["recall"], s["precision"]) == (2, pytest.approx(2 / 3), 1.0)


def test_zero_values_match_only_zero(spark):
    g = spark.createDataFrame([("s", 1, "a", 0.0, None)], "set_id string, id long, text string, value double, year int")
    r = spark.createDataFrame([("s", 1, "b", 0.0, None), ("s", 2, "c", 0.0001, None)], "set_id string, id long, text string, value double, year int")
    assert [x["r"] for x in matching.candidates(g, r).collect()] == [1]


def test_job_transitions(spark):
    df = spark.createDataFrame([(1, "r", 5, "QUEUED"), (2, "r", 3, "QUEUED"), (3, "s", 1, "FAILED")], "id long, run_id string, created_at long, status string")
    assert state.next_job(df).first()["id"] == 2
    assert {r["id"]: r["status"] for r in state.claim_next(df).collect()} == {1: "QUEUED", 2: "RUNNING", 3: "FAILED"}
    done = spark.createDataFrame([(2, "DONE")], "id long, outcome string")
    assert {r["id"]: r["status"] for r in state.finish(state.claim_next(df), done).collect()}[2] == "DONE"
    p = spark.createDataFrame([(1, {"a": "1", "b": "2"})], "id long, payload map<string,string>")
    u = spark.createDataFrame([(1, {"a": None, "c": "3"})], "id long, update map<string,string>")
    assert state.merge_payload(p, u).first()["payload"] == {"b": "2", "c": "3"}


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"), embedding_dim=2)
    claims = spark.createDataFrame([("c1", "r", "SUPPORTED"), ("c2", "r", "SUPPORTED")], "id string, run_id string, text string")
    s.replace("claims", "r", claims.withColumn("stance", F.lit("asserted")))
    s.replace("verdicts", "r", claims.select(F.col("id").alias("claim_id"), "run_id"))
    s.replace_claims("r", claims.where("id = 'c1'").withColumn("stance", F.lit("asserted")))
    assert [r["claim_id"] for r in s.read("verdicts", "r").collect()] == ["c1"] and s.read("claims").count() == 1
    with pytest.raises(PySparkException):
        s.replace("claims", "r", claims.withColumn("stance", F.lit("unsure")))
    s.append("vectors", "r", spark.createDataFrame([(1, [3.0, 4.0])], "chunk_id long, embedding array<float>"))
    assert s.read("vectors", "r").first()["embedding"] == pytest.approx([0.6, 0.8])
    with pytest.raises(PySparkException):
        s.append("vectors", "r", spark.createDataFrame([(1, [0.0, 0.0])], "chunk_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        store.Store(spark, str(tmp_path / "db"), embedding_dim=3)


def test_guards(spark):
    rows = spark.createDataFrame([("x",), (None,)], "prompt_hash string")
    with pytest.raises(ValueError):
        verify.assert_fresh(rows, "prompt_hash", "x")
    docs = spark.createDataFrame([("REPORT",), ("REPORT",)], "kind string")
    for df in (docs, docs.limit(0)):
        with pytest.raises(ValueError):
            verify.assert_one_report(df)


def test_readers(spark, tmp_path):
    p = tmp_path / "golden.jsonl"
    p.write_text('{"text": "a", "value": 1.5}\n\n{"text": "b", "year": 2020}\n')
    assert sorted(r["text"] for r in readers.golden(spark, str(p)).collect()) == ["a", "b"]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "pdf/b.pdf").write_bytes(b"nope")
    assert sorted(r["valid"] for r in readers.pdfs(spark, str(tmp_path / "pdf")).collect()) == [False, True]


def test_judge_port(spark):
    req = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    ok = spark.createDataFrame([("a", '{"verdict": "SUPPORTED"}'), ("b", '{"verdict": "X"}')], "custom_id string, json string")
    assert sorted(r["answer"]["verdict"] for r in readers.judge_replay(req, ok, "verdict string").collect()) == ["SUPPORTED", "X"]
    assert [r[0] for r in readers.unanswered(req, ok.where("custom_id = 'a'")).collect()] == ["b"]
    with pytest.raises(PySparkException):
        readers.judge_replay(req, ok.where("custom_id = 'a'"), "verdict string").collect()
    with pytest.raises(ValueError):
        readers.judge_replay(req.limit(1), ok, "verdict string")


def test_progress_stream(spark, tmp_path):
    log = spark.createDataFrame([("r", "ingest", "running", 1), ("r", "ingest", "done", 2), ("r", "extract", "running", 3)], "run_id string, step string, status string, seq long")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = progress.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["step"]: r["status"] for r in spark.table("latest").collect()} == {"ingest": "done", "extract": "running"}


def test_compare_without_scores(spark):
    a = scoring.accuracy(spark.createDataFrame([("x", "UNVERIFIABLE", None), ("y", "SUPPORTED", None)], "run_id string, verdict string, stance string"), "run_id")
    got = {r["metric"]: (r["a_label"], r["b_label"], r["delta_label"]) for r in views.compare(a, "x", "y").collect()}
    assert got["accuracy"] == ("—", "100%", "—") and got["supported"] == ("0", "1", "+1")


def test_scores_over_pairs(spark):
    golden = spark.createDataFrame([("s", 1, "a", "SUPPORTED", "asserted"), ("s", 2, "b", "SUPPORTED", "disavowed"), ("s", 3, None, "CONTRADICTED", None), ("t", 1, "c", "SUPPORTED", "asserted")], "set_id string, id long, text string, verdict string, stance string")
    rows = spark.createDataFrame([("s", 7, "SUPPORTED", None), ("s", 8, "PENDING", "asserted"), ("s", 9, None, "disavowed")], "set_id string, id long, verdict string, stance string")
    paired = spark.createDataFrame([("s", 1, 7), ("s", 2, 8), ("s", 3, 9)], "set_id string, g long, r long")
    classes = matching.verdict_classes(golden, rows, paired)
    assert sorted(tuple(r) for r in classes.collect()) == [("s", "CONTRADICTED", 1, 1, 0), ("s", "SUPPORTED", 2, 2, 1), ("t", "SUPPORTED", 1, 0, 0)]
    assert sorted(tuple(r) for r in matching.verdict_score(classes).collect()) == [("s", 3, 3, 1, 1 / 3, 1.0), ("t", 1, 0, 0, 0.0, 0.0)]
    assert sorted(tuple(r) for r in matching.stance_score(golden, rows, paired).collect()) == [("s", 1, 2, 0), ("t", 0, 0, 1)]
    assert [tuple(r) for r in matching.stance_disagreements(golden, rows, paired).collect()] == [("s", 2, "b", "disavowed", "asserted")]
    assert [tuple(r) for r in matching.missed(golden, paired).collect()] == [("t", 1, "c")]
    assert matching.verdict_score(matching.verdict_classes(golden.limit(0), rows, paired)).count() == 0


def test_folding(spark):
    df = spark.createDataFrame([("Čapek's Őr, Dvořák — naïve Łódź", 1), (None, 2), ("", 3)], "t string, i int")
    rows = df.select(T.fold_words("t").alias("w"), T.n_words("t").alias("n"), "i").orderBy("i").collect()
    assert rows[0]["w"] == ["capek", "s", "or", "dvorak", "naive", "łodz"] and rows[0]["n"] == 6
    assert rows[1]["w"] is None and rows[2]["w"] == [] and rows[2]["n"] == 0


def test_phrases_and_scopes(spark):
    chunks = spark.createDataFrame([(1, "a", "well known rain"), (2, "a", "known well"), (3, "b", "well known"), (4, "a", None), (5, "a", "well well known known")], "chunk_id long, run string, text string")
    asked = spark.createDataFrame([(7, "a", "well-known"), (8, "b", "rain known"), (9, "b", '"')], "query_id long, run string, text string")
    rows = retrieval.bm25(chunks, asked, same=["run"]).orderBy("query_id", "rank").collect()
    assert {(r["query_id"], r["chunk_id"]) for r in rows} == {(7, 1), (7, 5), (8, 3)}
    everywhere = retrieval.bm25(chunks, asked).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in everywhere} == {(7, 1), (7, 3), (7, 5), (8, 1), (8, 2), (8, 3), (8, 5)}
