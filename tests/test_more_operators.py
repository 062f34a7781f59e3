import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.functions import html
from evidentia.operators import dossier, frames, leases, mentions, prototypes
from evidentia.streaming.ledger import job_states

#: prototype: mean of the last 900 s, Wh, peak W, samples of 28 to 32 C, highest C.
EXPECTED = {"P1": (35.0465, 0, 0, 5596, 35.0465), "P2": (29.6957, 30.0, 5, 21388, 29.6957), "P3": (29.5, 98.4720, 16.6154, 21439, 29.5), "P4": (30.3333, 0, 0, 21405, 30.3333), "P5": (31.2032, 65.0, 40, 21424, 31.2305)}


def test_prototypes(spark):
    found = {r.prototype: r for r in prototypes.simulate_all(prototypes.runs(spark)).collect()}
    for name, (mean, wh, peak, inside, top) in EXPECTED.items():
        r = found[name]
        assert (r.stabilised_c, r.energy_wh, r.peak_w, r.max_c) == pytest.approx((mean, wh, peak, top), abs=1e-3), name
        assert r.in_band == inside


def test_series_agree_with_fold(spark):
    rows = spark.createDataFrame([(1, 25.0, 37.0, 960.0), (2, 22.0, 36.0, 700.0)], "id long, ambient_c double, skin_c double, capacity double")
    last = {(r.id, r.prototype): (r.energy_wh, r.top) for r in prototypes.series(rows, steps=700).groupBy("id", "prototype").agg(F.max("energy_wh").alias("energy_wh"), F.max("temperature_c").alias("top")).collect()}
    for r in prototypes.simulate_all(rows, steps=700).collect():
        assert last[r.id, r.prototype] == pytest.approx((r.energy_wh, r.max_c), abs=1e-9)
    with pytest.raises(ValueError):
        prototypes.simulate(rows, "P1", steps=0)


EVENTS = [(1, 7, "claim", 0), (2, 7, "create", 1), (3, 7, "claim", 2), (4, 7, "claim", 100), (5, 7, "progress", 7000), (6, 7, "claim", 9000), (7, 7, "claim", 14800), (8, 7, "complete", 14900), (9, 7, "fail", 15000), (10, 7, "claim", 15001), (11, None, "create", 5), (12, 8, "create", 3), (13, 8, None, 4), (14, 8, "fail", 5), (15, 8, "claim", 6)]


def events(spark):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(e, j, a, start + datetime.timedelta(seconds=s)) for e, j, a, s in EVENTS], "event_id long, job long, action string, ts timestamp")


def test_leases(spark):
    found = {r.event_id: (r.disposition, r.attempts) for r in leases.dispositions(events(spark)).collect()}
    assert found == {
        1: ("unknown", 0), 2: ("created", 0), 3: ("claimed", 1), 4: ("already_running", 1), 5: ("progressed", 1), 6: ("already_running", 1), 7: ("claimed", 2), 8: ("ended", 2), 9: ("completed", 2), 10: ("completed", 2),
        12: ("created", 0), 13: ("ignored", 0), 14: ("ended", 0), 15: ("terminal", 0),
    }
    assert leases.dispositions(events(spark).where("false")).count() == 0


def test_streaming_ledger(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = events(spark)
    rows.where("event_id <= 5").coalesce(1).write.mode("append").parquet(source)
    rows.where("event_id >= 5").coalesce(1).write.mode("append").parquet(source)  # event 5 is delivered twice
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = []
    q = job_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, i: out.extend((i, *r) for r in df.collect())).start()
    q.awaitTermination(120)
    assert q.exception() is None
    last = {r[1]: r[2:] for r in sorted(out)}
    assert last == {7: ("completed", 2, 1), 8: ("failed", 0, 0)}


PAGE = "<html><head><title>no</title></head><body><p>a<b>b</b> &amp; c<script>x<y</script><!-- z --><svg><text>t</text></svg> d</p></body></html>"


def test_html_text(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<body>open <p>tag")], "id long, html string")
    assert [r[0] for r in df.orderBy("id").select(html.html_text("html")).collect()] == ["a b & c d", "", "", "open tag"]
    assert [r[0] for r in df.orderBy("id").select(html.tag_free(F.col("html"))).collect()] == ["a b &amp; c d", "", "", "open tag"]


def test_images_and_sitemap(spark):
    page = '<meta property="og:image" content="o.png"><img alt="" src="a.jpg" srcset="a.jpg 1x, b.jpg 2x"><img src="data:x"><source srcset="c.webp 100w">'
    site = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>"
    ld = '<script type="application/ld+json">{"@type":"Product"}</script>'
    r = spark.createDataFrame([(page, site, ld)], "p string, s string, l string").select(html.images(F.col("p")), html.sitemap_locations(F.col("s")), html.json_ld(F.col("l"))).first()
    assert list(r) == [["a.jpg", "b.jpg", "c.webp", "o.png"], ["http://a/1", "http://a/2"], ['{"@type":"Product"}']]


def test_mentions_and_layers(spark):
    text = "😀 Gel-Memory  foam 50 kg/m3, thickness: 5 cm. Memory foams no. Coir"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    found = [(r.alias, r.material, r.start, r.stop) for r in mentions.mentions(df).orderBy("start", F.desc("stop")).collect()]
    assert found == [("Gel-Memory  foam", "gel_memory_foam", 2, 18), ("Memory  foam", "memory_foam", 6, 18), ("Coir", "rubberised_coir", len(text) - 4, len(text))]
    assert [(r.position, r.material, r.thickness_mm, r.density) for r in mentions.layers(df).orderBy("position").collect()] == [(1, "gel_memory_foam", 50.0, 50.0), (2, "memory_foam", 50.0, 50.0), (3, "rubberised_coir", 50.0, 50.0)]


def test_useful_names(spark):
    rows = [("Abc™", None, True), ("abc", "x", False), ("foam", "gel", False), ("ResiTec Foam", None, True), ("Plain name", None, False), ("Cloudcell", "memory foam", True), ("Cloudcell", "cloudcell", False)]
    df = spark.createDataFrame([(n if len(n) != 4 or "™" not in n else "Abcd™", m, w) for n, m, w in rows], "name string, material string, want boolean")
    assert all(r.got == r.want for r in df.select("want", dossier.is_useful_name(F.col("name"), F.col("material"), ("foam",)).alias("got")).collect())


def test_budget(spark):
    df = spark.createDataFrame([(1, 50), (2, 500), (3, 60), (4, 60)], "id long, chars int")
    assert [(r.id, r.allowed) for r in frames.within_budget(df, F.col("chars"), [F.col("id")], each=100, total=190).orderBy("id").collect()] == [(1, 50), (2, 100), (3, 40)]
