"""Asking, evaluating, appending with roll-back, waves, archives: small indexes with stand-in services."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veldra.operators import chunking, engine, evaluation, expansion, methods, models, reports
from veldra.sources import providers, stores

TEXTS = ["the rate is 35 percent", "the limit is 30 000 euros", "cats sleep all day", "dogs bark at night", "the rate of the other tax is 20", "nothing here"]


@pytest.fixture
def chunks(spark):
    rows = [(i, t, f"f{i // 2}.html", f"statute {i // 3}", f"c{i // 3}", f"title {i}", str(i), 1, False) for i, t in enumerate(TEXTS)]
    made = spark.createDataFrame(rows, "idx long, text string, source_file string, statute_name string, chapter string, section_title string, section_number string, part_total int, is_superseded boolean")
    vectors = providers.embed(made).select("idx", F.col("embedding").alias("vector"))
    return stores.staged(made.join(vectors, "idx"), "test")


@pytest.mark.parametrize("method, columns", [("section_v1", 4), ("hybrid_section_v1", 8), ("graph_v1", 7), ("hybrid_graph_section_v1", 11)])
def test_ask_by_each_route(spark, chunks, method, columns, tmp_path):
    e = engine.Engine(chunks, method, store=f"file://{tmp_path}/index")
    questions = spark.createDataFrame([(1, "what is the rate"), (2, "  "), (3, "limit")], "qid long, question string")
    assert len(e.retrieve(questions).columns) == columns
    got = {r.qid: r for r in e.ask(questions).collect()}
    assert got[2].error == "question is required" and got[2].answer == "" and got[2].sources is None
    assert "rate" in got[1].answer and got[1].error is None and got[1].method == method
    assert [s["rank"] for s in got[3].sources] == list(range(len(got[3].sources))) and got[3].sources[0].title == "f0"
    again = engine.Engine(chunks.limit(0), method, store=f"file://{tmp_path}/index")  # what the store has is not built again
    if e.spec.retriever != "dense":
        assert (again.index.postings.count() if e.spec.retriever == "hybrid" else again.adjacency.count()) > 0


def test_confidence_and_failing_chat(spark, chunks):
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2).cast("double").alias("top1_similarity"))
    model = models.fit(rows, ["top1_similarity"], "logreg_l2", {"c": 1.0})

    def chat(prompts):
        if any("limit" in p.rpartition("Question: ")[2] for p in prompts):
            raise RuntimeError("no service")
        return ["fine"] * len(prompts)

    names = [c for c in engine.signals.fingerprint(spark.createDataFrame([(1, "a")], "qid long, question string"), engine.rt.dense_topk(chunks, chunks.select(F.col("idx").alias("qid"), "vector"), 1), chunks).columns]
    feature = next(c for c in names if "sim" in c)
    model = models.fit(rows.withColumnRenamed("top1_similarity", feature), [feature], "logreg_l2", {"c": 1.0})
    e = engine.Engine(chunks, "section_v1", chat=chat, scorer=(model, [feature]))
    got = {r.qid: r for r in e.ask(spark.createDataFrame([(1, "the rate is 35 percent"), (3, "limit")], "qid long, question string")).collect()}
    assert got[1].answer == "fine" and got[1].confidence.label in ("Looks complete", "May be incomplete")
    assert got[3].answer == "" and got[3].error == "RuntimeError: no service" and got[3].sources and got[3].confidence is not None


def test_rewritten_questions_are_retrieved_by_their_translation(spark, chunks):
    known = spark.createDataFrame([("mikä on raja", "the limit is 30 000 euros")], "question string, translation string")
    e = engine.Engine(chunks, "section_v1_qfi", translations=known)
    top = e.retrieve(spark.createDataFrame([(1, "mikä on raja")], "qid long, question string")).where("rank = 0").first()
    assert top.idx == 1


@pytest.mark.parametrize("method", ["section_v1", "hybrid_graph_section_v1"])
def test_evaluation_goes_on_where_it_broke_off(spark, chunks, tmp_path, method):
    bank = spark.createDataFrame(
        [("a", "basic", "what is the rate", "35 percent", ["the rate is 35 percent"]), ("b", "basic", "what is the limit", "the limit is 99 dollars of gold", []), ("c", "hard", "", "x", ["y"])],
        "id string, tier string, question string, answer string, answer_key_facts array<string>",
    )
    path, e = f"file://{tmp_path}/results", engine.Engine(chunks, method)
    asked = []
    first = e.evaluate(bank.where("id = 'a'"), path)
    assert [(r.id, r.passed, r.n_facts_total) for r in first.collect()] == [("a", True, 1)]
    got = {r.id: r for r in e.evaluate(bank, path).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].passed and not got["b"].passed and got["b"].n_facts_total == 1
    assert got["a"].sources and got["a"].top1_similarity > 0 and got["a"].answer_expected == "35 percent"
    assert got["a"].fact_judgements[0].verdict == "PASS" and got["b"].fact_judgements[0].key_fact == "the limit is 99 dollars of gold"
    if "graph" in method:
        assert len(got["a"].graph.distances) == len(got["a"].sources)
    assert e.evaluate(bank, path).count() == 3 and not asked


def test_a_judge_that_fails_or_babbles(spark, chunks, tmp_path):
    bank = spark.createDataFrame([("a", "basic", "what is the rate", "35", ["f1", "f2"])], "id string, tier string, question string, answer string, answer_key_facts array<string>")

    def judge(prompts):
        if any("Fact: f2" in p for p in prompts):
            raise ValueError("busy")
        return ["no json"] * len(prompts)

    r = engine.Engine(chunks).evaluate(bank, f"file://{tmp_path}/r", judge).first()
    assert (r.passed, r.n_facts_total, r.judge_error) == (False, 2, "ValueError: busy") and {j.verdict for j in r.fact_judgements} == {"ERROR"}


def test_numbers_are_gapless_over_many_ranges(spark):
    chunks = spark.range(0, 300_000, 1, 8).select((F.col("id") * 7919 % 300_000).alias("k"), F.lit("p").alias("publisher"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = chunking.number_chunks(chunks, ["k"], 5)
        wrong = got.where(F.col("chunk_id") != F.format_string("p_%07d", F.col("k") + 5)).count()
        assert wrong == 0 and got.select("chunk_id").distinct().count() == 300_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_sums_over_ranges(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("lane"), (F.col("id") % 7 == 0).alias("passed"))
    got = {(r.lane, r.id): (r.n_pass, r.accuracy) for r in evaluation.running(rows.repartition(6), "id", "lane").collect()}
    for lane in range(3):
        n = p = 0
        for i in range(lane, 5000, 3):
            n, p = n + 1, p + (i % 7 == 0)
            assert got[str(lane), i] == (p, p / n)


def test_window_offsets(spark):
    text = "  one two\n" + "x" * 300 + " " + " ".join(f"w{i}" for i in range(50)) + "  "
    docs = spark.createDataFrame([(1, "f", "p", text), (2, "f", "p", None)], "doc_id long, source_file string, publisher string, text string")
    for r in chunking.window_chunks(docs, 10, 3).collect():
        assert text[r.char_offset :].startswith(r.text.split(" ")[0]) and text[: r.char_offset].split() == text.split()[: 7 * r.part]


def _store(spark, base, n=4):
    rows = [(i, f"a_{i:07d}", f"old{i}.html", "a", i, 3, f"text {i}") for i in range(n)]
    made = spark.createDataFrame(rows, "idx long, chunk_id string, source_file string, publisher string, part int, n_tokens int, text string")
    made.write.parquet(f"{base}/chunks")
    providers.embed(made).write.parquet(f"{base}/vectors")


def _cut(files):
    return files.select(F.col("path").alias("source_file"), "publisher", F.lit(0).alias("part"), F.lit(2).alias("n_tokens"), F.concat(F.lit("new "), "path").alias("text"))


def test_append(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    _store(spark, base)
    files = spark.createDataFrame([("old1.html", "a"), ("n1.html", "a"), ("n2.html", "b")], "path string, publisher string")
    plan = expansion.append_files(spark, base, files, _cut, providers.embed, 64, dry_run=True)
    assert (plan["files"], plan["files_known"], plan["chunks_new"], plan["tokens"], plan["written"]) == (2, 1, 2, 4, False)
    assert spark.read.parquet(f"{base}/chunks").count() == 4
    assert expansion.append_files(spark, base, files, _cut, providers.embed, 64)["written"]
    rows = {r.idx: r.chunk_id for r in spark.read.parquet(f"{base}/chunks").where("idx > 3").collect()}
    assert rows == {4: "a_0000004", 5: "b_0000005"} and spark.read.parquet(f"{base}/vectors").count() == 6
    assert expansion.append_files(spark, base, files, _cut, providers.embed, 64)["chunks_new"] == 0
    assert not [p for p in (tmp_path / "s").iterdir() if "backup" in p.name]


def test_append_rolls_back(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    _store(spark, base)
    files = spark.createDataFrame([("n1.html", "a"), ("n2.html", "b")], "path string, publisher string")
    with pytest.raises(ValueError, match="do not agree"):
        expansion.append_files(spark, base, files, _cut, lambda c: providers.embed(c.limit(1)), 64)
    assert [spark.read.parquet(f"{base}/{t}").count() for t in ("chunks", "vectors")] == [4, 4]
    providers.embed(spark.createDataFrame([(9, "x")], "idx long, text string")).write.mode("append").parquet(f"{base}/vectors")
    with pytest.raises(ValueError, match="build it anew"):
        expansion.append_files(spark, base, files, _cut, providers.embed, 64)


def test_waves_go_on_where_they_broke_off(spark, tmp_path):
    path, calls = f"file://{tmp_path}/v", []
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "idx long, text string")
    stores.append_vectors(providers.embed(chunks.where("idx < 7")), path, 64)
    assert providers.embed_in_waves(chunks, path, wave=10) == 50 == spark.read.parquet(path).select("idx").distinct().count()
    assert providers.embed_in_waves(chunks, path, wave=10) == 50 and not calls
    with pytest.raises(ValueError, match="stored for"):
        providers.embed_in_waves(chunks.where("idx < 9"), path)


def test_archives_with_bad_entries(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("../up/a.html", "A")
        z.writestr("dir/b?.html", "B" * 100)
    raw = bytearray(data.getvalue())
    raw[raw.index(b"B" * 100)] ^= 1  # its checksum no longer holds
    (tmp_path / "one.zip").write_bytes(raw)
    (tmp_path / "two.zip").write_bytes(b"no archive")
    rows = {r.name: r for r in stores.extract_archives(spark, f"file://{tmp_path}").collect()}
    assert bytes(rows["up/a.html"].content) == b"A" and rows["dir/b_.html"].error and rows[None].error


def test_reports_are_put_in_place(spark, tmp_path):
    for n in (5, 6):
        path = reports.write_report(spark, f"file://{tmp_path}", "m", json.dumps({"method": "m", "n_samples": n, "cv_mean_accuracy": 0.5}))
    assert path.endswith("classifier_m_report.json") and reports.read_reports(spark, f"file://{tmp_path}").first().n_samples == 6


def test_counts_of_selection(spark):
    files = spark.createDataFrame([("x/verolaki.html", "finlex"), ("x/muu.html", "finlex"), ("y/muu.html", "vero"), (None, "finlex")], "path string, publisher string")
    assert {tuple(r) for r in expansion.kept_and_total(files).collect()} == {("finlex", 1, 3), ("vero", 1, 1)}
    assert sorted((r.path for r in expansion.left_out(files).collect()), key=repr) == sorted([None, "x/muu.html"], key=repr)
    asked = spark.createDataFrame([(1,), (2,), (2,), (3,)], "qid long")
    assert tuple(expansion.matched_questions(asked, asked.where("qid = 2")).first()) == (1, 3)


def test_joins_with_the_bank(spark):
    results = spark.createDataFrame([("a", True), ("b", False)], "id string, passed boolean")
    bank = spark.createDataFrame([("a", "q", 3, ["f"])], "id string, question string, difficulty int, answer_key_facts array<string>")
    assert {r.id: r.difficulty for r in evaluation.with_bank(results, bank).collect()} == {"a": 3, "b": None}
    features = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("z", 0.0)], "id string, x double")
    assert [r.id for r in evaluation.three_way(features, results, bank).collect()] == ["a"]
    assert spark.range(1).select(evaluation.utc_stamp().alias("t")).first().t.endswith("Z")


def test_out_of_fold_confusion(spark):
    rows = spark.range(60).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 3).cast("double").alias("a"))
    r = models.out_of_fold_confusion(rows, ["a"], "decision_tree", {"depth": 2, "leaf": 4}).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (20, 40, 0, 0) and r.confident_precision == 1.0


def test_method_names():
    for name, retriever, index in [("hybrid_graph_section_v1", "hybrid_graph", "section_v1"), ("hybrid_graph", "hybrid_graph", "section_v1"), ("hybrid_graph_x", "hybrid_graph", "section_x"), ("graph_v2", "graph", "section_v2"), ("graph", "graph", "section_v1"), ("hybrid_section_v1_qfi", "hybrid", "section_v1"), ("section_v1_qfi", "dense", "section_v1"), ("baseline", "dense", "baseline")]:
        m = methods.resolve(name)
        assert (m.retriever, m.index, m.rewrites) == (retriever, index, name.endswith("_qfi"))


def test_what_administrators_see(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    params = {"depth": 2, "leaf": 4}
    tree = models.fit(rows, ["a", "b"], "decision_tree", params)
    table = spark.createDataFrame([("m", "decision_tree", 1.0), ("n", "logreg_l2", 0.5)], "method string, model string, cv_bal_acc double")
    seen = reports.admin("m", rows, ["a", "b"], "decision_tree", params, tree, table)
    assert [m["model"] for m in seen["models"]] == ["decision_tree"] and seen["importances"][0]["name"] == "a" and len(seen["tree"]) >= 3
    assert seen["headline"] == {"questions": 60, "accuracy": pytest.approx(1 / 3), "right_when_confident": 1.0, "wrong_answers_flagged": 1.0}
    examples = rows.select("id", "a", "b", (F.col("label") == 1).alias("passed"), F.lit("q").alias("question"))
    shown = reports.pathways(examples, ["a", "b"], ["7", "none", "3"], tree)
    assert [(s["id"], s["passed"], s["path"][-1]["prediction"]) for s in shown] == [("7", False, 0.0), ("3", True, 1.0)]
    assert "path" not in reports.pathways(examples, ["a"], ["3"])[0]


def test_methods_on_offer(spark):
    held = spark.createDataFrame([("baseline", 1), ("baseline", 2), ("other", 3)], "method string, n int")
    got = [(r.id, r.recommended, r.has_classifier) for r in reports.method_list(spark, held).collect()]
    assert got[0] == ("section_v1", True, False) and ("baseline", False, True) in got and len(got) == len(methods.CATALOG)


def test_pages_are_scanned_in_order(spark, tmp_path):
    for name in ("b/x.html", "a/y.html", "a/z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"<p>{name} é</p>", encoding="utf-8")
    rows = stores.scan_html(spark, f"file://{tmp_path}", "vero").collect()
    assert [r.path.rsplit("/", 2)[1:] for r in rows] == [["a", "y.html"], ["b", "x.html"]]
    assert rows[0].html == "<p>a/y.html é</p>" and rows[0].publisher == "vero"
