import json
import threading
import urllib.request

from pyspark.sql import functions as F

from weftline.operators import metrics, models
from weftline.operators.features import prepare
from weftline.plans import linkage
from weftline.plans.console import Console, package, report_markdown, serve
from weftline.sources.records import clean_records
from weftline.sources.synthetic import Generator


def test_common_terms_are_compared(spark):
    """Records that share only a word of more than 1,000 records meet, in salted blocks; a cap is an option."""
    data = [(f"S1-{i}", "alpha", f"street{i}", "us") for i in range(3)] + [(f"S2-{i}", "alpha", f"road{i}", "us") for i in range(1100)]
    records = clean_records(spark.createDataFrame(data, "entity_id string, business_name string, business_address string, country string"))
    p = prepare(records.withColumn("src", F.substring("entity_id", 2, 1).cast("int"))).persist()
    assert linkage.channel_pairs(p, 2000)["word"].count() == 3300
    assert linkage.channel_pairs(p, df_cap=1000)["word"].count() < 3300


def test_end_to_end(spark, tmp_path):
    records, truth = Generator(3).frames(spark, 60)
    bundle = linkage.train(records, truth, kind="logistic")
    assert bundle.report["chosen"] in bundle.report["cv"] and len(bundle.report["cv"]) == 6
    assert bundle.words.legal and bundle.words.cues
    linkage.save(bundle, spark, str(tmp_path / "model"))
    bundle = linkage.load(spark, str(tmp_path / "model"))
    other, real = Generator(9, hard=True).frames(spark, 50)
    scored, universe = linkage.predict(other, bundle)
    got = metrics.score(universe.withColumnRenamed("s1", "i"), scored.where("emitted"), real).first()
    assert got.n == 50 and got.macro_f > 0.8
    assert scored.where("emitted AND p IS NULL").count() == 0

    # a new record against the stored ones answers as in a batch with them
    asked = other.where("entity_id = 'S1-00001'") if other.where("entity_id = 'S1-00001'").count() else other.where("src = 1").orderBy("entity_id").limit(1)
    one = asked.first().entity_id
    kept = linkage.store(other.where(F.col("entity_id") != one), bundle)
    new = linkage.resolve(asked, kept, bundle).collect()
    batch = {r.j for r in scored.where(F.col("i") == one).where("emitted").collect()}
    assert {r.i for r in new} == {one} and {r.j for r in new if r.emitted} == batch
    alone = linkage.resolve(asked, kept, bundle, compete=False).collect()
    assert {r.j for r in alone} == {r.j for r in new} and len([r for r in alone if r.emitted]) >= len(batch)

    # an isotonic rule decides by what the bundle's calibrator makes of the scores
    assert bundle.calibrator.boundaries.size >= 1
    bundle.calibrator = models.calibrator(spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)], "p double, y double"))
    bundle.rule = linkage.Rule("threshold", 0.6, calibrated=True, exclusive=False)
    kept = linkage.predict(other, bundle)[0].where("p IS NOT NULL").select("pc", "emitted").collect()
    assert kept and all(r.pc == 0.5 and not r.emitted for r in kept)

    pool = linkage.prepared(other, bundle.words)
    _, features = linkage.pool_features(pool, linkage.cut(linkage.block(pool)), bundle)
    console = Console(other, scored.persist(), bundle.report, explain=linkage.explainer(features, bundle))
    assert console.health() == {"status": "warming"}
    console.warm()
    page = console.entities(kind="matched", limit=5)
    assert 0 < len(page) <= 5
    detail = console.entity(page[0]["i"])
    assert detail["candidates"] and len(detail["curve"]) > 1 and len(detail["pruned"]) <= 6
    first = detail["candidates"][0]
    assert len(first["why"]["features"]) == 8 and set(first["shared_name"]) <= set(first["business_name"].lower().split())
    server = serve(console, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/api/health") as r:
        assert json.load(r) == {"status": "ready"}
    server.shutdown()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.tsv").write_text("1")
    assert package(str(tmp_path / "x"), str(tmp_path / "o.zip"), ["a.tsv"]) == ["a.tsv"]
    assert "## t" in report_markdown("r", {"n": 1}, {"t": [{"a": 1}]})


def test_folds_by_country(spark):
    """Labels of one country are one fold; pruning and thresholds are carried over; unseen labels weigh."""
    records, truth = Generator(5).frames(spark, 40)
    coming = records.withColumn("country", F.when(F.col("entity_id").endswith("1"), F.lit("Atlantis")).otherwise(F.col("country")))
    bundle = linkage.train(records, truth, kind="logistic", coming=coming, by_country=True)
    asked = coming.where("src = 1")
    assert bundle.report["unseen_share"] == asked.where("country = 'Atlantis'").count() / asked.count()
    assert set(bundle.report["loco"]) == set(bundle.report["cv"])
