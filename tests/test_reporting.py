"""What a run hands on, against plain loops."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from caseloom.operators import reporting


def test_inputs(spark):
    rows = [(1, i, t, h, a, m) for i, (t, h, a, m) in enumerate([("uno", "h0", 2010, 1), ("largo texto", "nan", 2010, 1), ("otro texto!", " h2 ", None, None), (None, "h0", 2011, 2), ("x", "", 2011, 2)])] + [(2, 9, "", None, None, None)]
    panel = spark.createDataFrame(rows, "caso_id int, pos int, caso string, hechos_del_mes string, anio int, mes int").repartition(3)
    events = dict(reporting.sampled_events(panel, "caso_id", "hechos_del_mes", "pos").collect())
    assert events == {1: "h0\n---\nh2"}
    got = {r.caso_id: r for r in reporting.model_inputs(panel, "m", "v", 20).collect()}
    assert got[1].n_meses == 3 and got[1].request.endswith("largo texto\n\nh0\n---") and "(sin dato)" in got[2].request and got[2].n_meses == 1
    assert len({r.hash for r in got.values()}) == 2 and got[1].hash != reporting.model_inputs(panel, "m", "w", 20).filter("caso_id = 1").first().hash


def test_company_column(spark):
    eight = [f"c{i}" for i in range(9)]
    assert reporting.company_column(["EsMinera", "Com pañía", "x"], spark) == "Com pañía"
    assert reporting.company_column(["EsMinera", "Empresa Minera", "x"], spark) == "Empresa Minera"
    assert reporting.company_column(eight, spark) == "c7"


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("12", 'un "título"', "u", 5), ("3", "b, c", "v", None), ("", "sin", None, 0)], "numero string, titulo string, url string, bytes int").withColumn("extra", F.lit(1))
    reporting.write_manifest(rows, str(tmp_path))
    back = spark.read.csv(str(tmp_path / "manifiesto.csv"), header=True, quote='"', escape='"').na.fill("")
    assert back.columns == list(reporting.MANIFEST) and {(r.numero, r.titulo, r.bytes) for r in back.collect()} == {("12", 'un "título"', "5"), ("3", "b, c", ""), ("", "sin", "0")}
    lines = [json.loads(x) for p in Path(tmp_path / "manifiesto.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(x["numero"] for x in lines) == ["", "12", "3"] and set(lines[0]) == set(reporting.MANIFEST)
