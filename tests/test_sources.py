import json

from quire.operators import blocks as B
from quire.sources import readers as R


def test_layout_and_units(spark, tmp_path):
    block = {"type": "body", "text": "goes on", "x0": 1.0, "top": 2.0, "x1": 3.0, "bottom": 4.0, "order": 0, "nlines": 1, "size": 10.0, "list": True}
    page = {"page": 1, "width": 600, "height": 800, "columns": 1, "body_size": 10, "blocks": [block, {**block, "order": 1, "list": None}], "figures": [{"x0": 0.0, "top": 0.0, "x1": 1.0, "bottom": 1.0, "vector": True}], "rules": []}
    (tmp_path / "a_layout.json").write_text(json.dumps({"file": "a.pdf", "pages": [page, page]}))
    lay = R.read_layout(spark, f"{tmp_path}/a_layout.json")
    blocks = R.layout_blocks(lay)
    assert blocks.count() == 4 and R.pages(lay).count() == 2 and R.layout_boxes(lay, "figures").filter("vector").count() == 2 and R.layout_boxes(lay, "rules").count() == 0
    first = blocks.filter("page = 0 and block = 0").first()
    assert first.doc_id == "a" and first.is_list and not first.is_cell
    assert B.stitch_units(blocks, ["doc_id"], ["page", "ord"]).count() == 4
    (tmp_path / "a_units.json").write_text(json.dumps([{"uid": 0, "spans": ["0:1", "1:0"], "source": "x <y>", "target": "z"}, {"uid": 1, "spans": [], "source": "q", "target": ""}]))
    units = R.read_units(spark, f"{tmp_path}/a_units.json")
    assert [(r.page, r.block) for r in R.unit_blocks(units, blocks).orderBy("part").collect()] == [(0, 1), (1, 0)]
    assert units.filter("target is null").count() == 1
    assert R.preview_rows(units).first().html == "<tr><td>x &lt;y&gt;</td><td>z</td></tr>"


def test_cache_and_jobs(spark, tmp_path):
    assert R.read_cache(spark, f"{tmp_path}/none").count() == 0
    at = R.write_cache(spark.createDataFrame([("k", "v"), ("k", "v")], "key string, target_masked string"), f"{tmp_path}/c", 1)
    assert R.read_cache(spark, at).count() == 1
    (tmp_path / "jobs.json").write_text(json.dumps({"id": "1", "status": "running", "created": 0.0, "secret": "x"}))
    jobs = R.read_jobs(spark, f"{tmp_path}/jobs.json")
    assert jobs.first().status == "error" and "secret" not in jobs.columns
    R.write_jobs(jobs, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
