"""Chunking, sections, selection, evaluation, models, reports and stores on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from veldra.operators import chunking, evaluation, expansion, models, reports, sections
from veldra.sources import providers, stores
from veldra.streaming import incremental

STATUTE = """<html><body><h1>Laki X</h1><h2>1 luku</h2><p>dropped</p><h3 id="a">1 § Eka</h3><p>Teksti <a href="/l1">yksi</a><p>Toinen</p><script>var x;</script>
<h3>102 A § Toka</h3><ul><li>a</li><li>b <a href="/l2">c</a></li></ul><h2>2 luku</h2><h3>ei numeroa</h3><p>loppu</p><h4>28.12.2012/1081: muutos</h4><p>voimaan</p></body></html>"""
GUIDE = """<body><h1 class="taxxa-title">Ohje</h1><p class="attention-box">Ohje on KUMOTTU, katso <a href="/uusi">uusi</a></p><p>Johdanto</p><h2>2.1 Osa</h2>
<p>ylitarkastaja Matti</p><ol><li>yksi<ul><li>sisä</li></ul></li></ol><h3></h3><p>jatkuu</p></body>"""


def test_statute_sections():
    got = sections.parse_sections(STATUTE, "finlex")
    assert [(s["chapter"], s["section_number"], s["node_type"], s["paragraphs"]) for s in got] == [
        ("1 luku", "1", "section", ["Teksti yksi", "Toinen"]), ("1 luku", "102a", "section", ["a; b c"]), ("2 luku", "", "section", ["loppu"]), ("2 luku", "", "amendment_provision", ["voimaan"]),
    ]
    assert got[0]["section_id"] == "a" and got[0]["cross_refs"] == ["/l1"] and got[3]["amendment_date"] == "28.12.2012" and got[0]["statute_name"] == "Laki X"


def test_guide_sections():
    got = sections.parse_sections(GUIDE, "vero")
    assert [(s["section_title"], s["section_number"], s["paragraphs"]) for s in got] == [("Ohje", "", ["Johdanto"]), ("2.1 Osa", "2.1", ["yksi sisä; sisä", "sisä", "jatkuu"])]
    assert all(s["is_superseded"] and s["superseded_by"] == ["/uusi"] for s in got)
    with pytest.raises(ValueError):
        sections.parse_sections("", "other")


def test_section_rows_and_errors(spark):
    pages = spark.createDataFrame([("f1", "finlex", STATUTE), ("f2", "nobody", "x"), ("f3", "vero", None)], "source_file string, publisher string, html string")
    rows = sections.sections(pages).orderBy("source_file", "pos").collect()
    assert [(r.source_file, r.section_number, bool(r.error)) for r in rows] == [("f1", "1+102a", False), ("f1", "", False), ("f1", "", False), ("f2", None, True)]
    assert rows[0].section_title == "1 § Eka + 102 A § Toka" and rows[0].cross_refs == ["/l1", "/l2"]
    assert sections.toc_items('{"IndexItems": [{"Children": [{}, {}]}, {}]}') == 4 and sections.toc_items("no") == 0


def test_merge_chain_and_packing(spark):
    s = lambda i, n, chapter="c": {"chapter": chapter, "node_type": "section", "is_superseded": False, "section_id": "", "section_title": f"t{i}", "section_number": str(i), "paragraphs": ["x" * n], "cross_refs": [f"/{i}"], "raw_text": f"t{i}\n\n" + "x" * n}
    kind = "a array<struct<chapter:string,node_type:string,is_superseded:boolean,section_id:string,section_title:string,section_number:string,paragraphs:array<string>,cross_refs:array<string>,raw_text:string>>"
    rows = [s(1, 10), s(2, 10), s(3, 300), s(4, 10), s(5, 10, "d")]
    got = spark.createDataFrame([(rows,)], kind).select(chunking.merge_short(F.col("a")).alias("m")).first().m
    assert [(r.section_number, len(r.paragraphs)) for r in got] == [("1+2+3", 3), ("4", 1), ("5", 1)] and got[0].cross_refs == ["/1", "/2", "/3"]
    sizes = [300, 300, 100, 700, 50]
    paras = [" ".join(f"w{i}" for i in range(n)) for n in sizes]
    packed = spark.createDataFrame([("", paras)], "t string, p array<string>").select(chunking.pack_paragraphs(F.col("t"), F.col("p")).alias("x")).first().x
    assert [[len(p.split()) for p in g] for g in packed] == [[300], [300, 100], [700], [50]]
    pieces = chunking.section_chunks(spark.createDataFrame([("title", paras)], "section_title string, paragraphs array<string>")).collect()
    assert [(r.part_index, r.part_total) for r in pieces] == [(1, 4), (2, 4), (3, 4), (4, 4)] and pieces[0].text.startswith("title\n\n")


@pytest.mark.parametrize("n, want", [(0, []), (1, [1]), (512, [512]), (513, [512, 51]), (974, [512, 512]), (975, [512, 512, 51])])
def test_windows(spark, n, want):
    docs = spark.createDataFrame([(1, "f", "p", " ".join(["w"] * n))], "doc_id long, source_file string, publisher string, text string")
    assert [r.n_tokens for r in chunking.window_chunks(docs).orderBy("part").collect()] == want


def test_offsets_and_numbers(spark):
    text = "".join(f"{i:04d}" for i in range(100))
    pieces = [text[0:50], text[40:100], "short", "nowhere" * 10]
    got = spark.createDataFrame([(text, pieces)], "t string, p array<string>").select(chunking.char_offsets(F.col("t"), F.col("p")).alias("o")).first().o
    assert got == [0, 40, 41, 42]
    chunks = spark.range(0, 1000, 1, 7).select(F.col("id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("publisher"))
    assert [r.chunk_id for r in chunking.number_chunks(chunks, ["id"]).orderBy("id").collect()][-2:] == ["a_0000998", "b_0000999"]


def test_selection(spark):
    bank = spark.createDataFrame([(1, "What (ennakkopidätys and lähdevero)?", "", ["Lähdeveron määrä on 35", "short"]), (2, "Plain", "osinkotulo", [])], "qid long, question string, answer string, answer_key_facts array<string>")
    asked = expansion.anchors(bank)
    assert {r.qid: r.anchors for r in asked.collect()} == {1: ["ennakkopidatys", "lahdevero", "lahdeveron"], 2: ["osinkotulo"]}
    files = spark.createDataFrame([("x/Lähdeverolaki_ennakkopidätys.html",), ("x/lahdevero.html",), ("x/muu.html",)], "path string")
    assert [(r.qid, r.path, r.hits) for r in expansion.promote_failures(asked, files).collect()] == [(1, "x/Lähdeverolaki_ennakkopidätys.html", 2)]
    assert expansion.promote_keywords(files, [" ", ""]).count() == 0 and expansion.promote_keywords(files, ["MUU"]).count() == 1
    kept = files.where(expansion.relevant(F.col("path"), F.lit("finlex"))).count()
    assert kept == 2 and files.where(expansion.relevant(F.col("path"), F.lit("vero"))).count() == 3
    twins = spark.createDataFrame([(1, "a/B.html"), (2, "A/b.html"), (3, "c")], "pos long, path string")
    assert [r.stored for r in expansion.rescue_case(twins).orderBy("pos").collect()] == ["a/B.html", "A/b__case1.html", "c"]


def test_judging(spark):
    bank = evaluation.key_facts(spark.createDataFrame([("q1", "b", "ans", []), ("q2", "b", "x", ["rate 35", "limit 30"])], "id string, tier string, answer string, answer_key_facts array<string>"))
    answers = bank.withColumn("answer_generated", F.when(F.col("id") == "q1", "").otherwise("the rate is 35 and the limit 31"))
    rows = {r.id: r for r in evaluation.judge(answers, providers.offline_judge).collect()}
    assert (rows["q1"].passed, rows["q1"].n_facts_total) == (False, 1) and (rows["q2"].passed, rows["q2"].n_facts_passed) == (False, 1)
    broken = evaluation.judge(answers, lambda f, a: F.lit("not json")).collect()
    assert {x.j.verdict for r in broken for x in r.fact_judgements} == {"ERROR"}
    assert evaluation.overall(answers.withColumn("passed", F.lit(True)).limit(0)).first().accuracy is None
    assert evaluation.sample_exact(spark.range(83), "id", 10).count() == 8 and evaluation.sample_exact(spark.range(3), "id", 1).count() == 1


def test_models_and_reports(spark, tmp_path):
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    grid = {"dummy_majority": [{}], "decision_tree": [{"depth": 2, "leaf": 4, "weight": w} for w in (None, "balanced")], "logreg_l2": [{"c": 1.0, "weight": "balanced"}], "logreg_l1": [{"c": 10.0, "weight": None}]}
    found = models.bench(rows, ["a", "b"], grid)
    by = {b.name: b for b in found}
    assert found[0].scores["cv_mean_balanced_accuracy"] == 1.0 and by["dummy_majority"].scores["cv_mean_balanced_accuracy"] == 0.5
    tree = models.fit(rows, ["a", "b"], "decision_tree", {"depth": 2, "leaf": 4})
    nodes = models.tree_nodes(tree, ["a", "b"])
    path = models.decision_path(nodes, {"a": 0.0, "b": 1.0})
    assert path[0]["feature"] == "a" and path[-1]["prediction"] == 1.0 and len(models.tree_layout(nodes)) == len(nodes)
    assert models.tree_contributions(tree, ["a", "b"], path)[0][0::2] == ("a", True)
    line = models.fit(rows, ["a", "b"], "logreg_l2", {"c": 1.0})
    assert models.contributions(line, ["a", "b"], {"a": 0.0, "b": 3.0})[0][0] == "a"
    stores.save_model(tree, f"file://{tmp_path}/m", features=["a", "b"])
    again, facts = stores.load_model(spark, f"file://{tmp_path}/m")
    assert facts["features"] == ["a", "b"] and models.predict(again, rows).where("prediction <> label").count() == 0
    with pytest.raises(ValueError):
        models.fold_count(1, 9)
    (tmp_path / "classifier_m1_report.json").write_text(reports.report("m1", found, 20, 40, ["a", "b"]))
    (tmp_path / "classifier_old_report.json").write_text(json.dumps({"method": "x", "n_samples": 5, "cv_mean_accuracy": 0.5, "cv_mean_balanced_accuracy": None}))
    (tmp_path / "classifier_bad_report.json").write_text("[1, 2]")
    table = reports.summary(reports.read_reports(spark, f"file://{tmp_path}"), spark.createDataFrame([("m1", 0.3)], "method string, pass_rate double")).collect()
    assert [r.method for r in table] == ["m1"] * 4 + ["old"] and table[-1].model == "model" and table[0].is_best and table[0].pass_rate == 0.3


def test_stores(spark, tmp_path):
    base = f"file://{tmp_path}"
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "idx long, text string")
    assert stores.reuse_or_build(spark, f"{base}/c", lambda: chunks).count() == 5
    assert stores.reuse_or_build(spark, f"{base}/c", lambda: chunks.limit(0)).count() == 5
    stores.append_vectors(providers.embed(chunks.where("idx < 2")), f"{base}/v", 64)
    left = stores.pending(chunks, spark, f"{base}/v")
    assert sorted(r.idx for r in left.collect()) == [2, 3, 4]
    stores.append_vectors(providers.embed(left), f"{base}/v", 64)
    assert stores.load_index(chunks, spark.read.parquet(f"{base}/v")).count() == 5
    with pytest.raises(Exception, match="components"):
        stores.append_vectors(providers.embed(chunks), f"{base}/v2", 3)
    (tmp_path / "bank.json").write_text(json.dumps({"name": "n", "entries": [{"id": "a", "question": "q", "answer_key_facts": ["f"]}, {"id": "b"}]}))
    bank = stores.question_bank(spark, f"{base}/bank.json")
    bank.select("id").where("id = 'a'").write.parquet(f"{base}/results")
    assert [r.id for r in stores.resume(bank, spark, f"{base}/results").collect()] == ["b"]
    assert stores.translation_cache(spark, f"{base}/none").count() == 0
    stores.write_translations(spark.createDataFrame([("q", "k")], "question string, translation string"), f"{base}/tr")
    assert [tuple(r) for r in stores.translation_cache(spark, f"{base}/tr").collect()] == [("q", "k")]
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    stores.extend_manifest(spark, f"{base}/man", files.limit(1), {"run": 1})
    assert stores.extend_manifest(spark, f"{base}/man", files).count() == 2


def test_following_an_inbox(spark, tmp_path):
    base = f"file://{tmp_path}"
    for part in (range(0, 3), range(3, 5)):
        spark.createDataFrame([(i, f"t{i}") for i in part], "idx long, text string").write.mode("append").parquet(f"{base}/in")
        incremental.follow(spark, f"{base}/in", "idx long, text string", lambda d: d, providers.embed, f"{base}/store", f"{base}/check").awaitTermination()
    assert spark.read.parquet(f"{base}/store/chunks").count() == spark.read.parquet(f"{base}/store/vectors").count() == 5
