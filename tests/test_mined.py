"""The rollup of mined cases against a plain loop."""

import random
from collections import Counter

from caseloom.functions import lexicon as L
from caseloom.operators import mined

COLUMNS = "caso_id int, pos int, caso string, tipo string, departamento string, ubicacion string, actores string, actores_primarios string, anio int, mes int, numero_reporte string, es_socioambiental string, menciona_mineria string"
CATALOGUE = [(f"Mina{i}", f"Firma{i % 30}", (f"mina{i}", f"cerro {i}")) for i in range(130)]  # more than two numbers of bits


def rows(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["agua", "mina3", "cerro 70", "mina129", "Mina65", "rio", "ilegal", "informal", "polo", "nan"])
    out = []
    for i in range(n):
        out.append((rng.randrange(25), i, rng.choice([None, "", "nan", " ".join(word() for _ in range(rng.randrange(1, 8)))]), rng.choice([None, "", "Laboral", "laboral", "Comunal", "otro"]), rng.choice([None, "", " Puno ", "Puno", "Cusco"]), rng.choice(["", "cerca de  mina3", "Pueblo"]), rng.choice([None, "vecinos"]), rng.choice([None, "aa", "bb"]), rng.choice([None, 2010, 2011]), rng.choice([None, 3, 12]), rng.choice(["", "7", "12"]), rng.choice([None, "0", "1"]), rng.choice(["0", "1"])))
    return out


def plain(data, villages):
    groups = {}
    hits = lambda blob: [i for i, (_, _, aliases) in enumerate(CATALOGUE) if any(f" {a} " in f" {blob} " for a in aliases)]
    for r in data:
        blob = " ".join(x or "" for x in (r[2], r[5], r[7], r[6])).lower()
        blob = " ".join(blob.split())
        if hits(blob):
            groups.setdefault(r[0], []).append((r, blob))
    out = {}
    for case, own in groups.items():
        found = sorted({i for _, b in own for i in hits(b)})
        owners = list(dict.fromkeys(CATALOGUE[i][1] for i in found))
        kind = lambda t: {"laboral": "LABORAL", "comunal": "COMUNAL", "otro": "OTROS"}.get((t or "").lower(), "")
        mode = lambda values: Counter(v for v in values if v).most_common(1)[0][0] if any(values) else ""
        longest = lambda k: max([(r[k] or "").strip() for r, _ in own if (r[k] or "").strip() and r[k].lower() != "nan"], key=len, default="")
        dates = sorted(f"{r[8]}-{'03-31' if r[9] == 3 else '12-31'}" for r, _ in own if r[8] and r[9])
        names = [CATALOGUE[i][0] for i in found]
        told = [v for m in names for x, v, _ in sorted(villages, key=lambda y: y[2]) if x == m and any(v.lower() in b for _, b in own)]
        out[case] = (names, owners, mode([kind(r[3]) for r, _ in own]), mode([(r[4] or "").strip() for r, _ in own]).upper(), longest(2), dates[0] if dates else "", dates[-1] if dates else "", len({(r[8], r[9]) for r, _ in own}), len(own), "Sí" if any("ilegal" in b for _, b in own) else "No", int(any(r[11] == "1" for r, _ in own)), "; ".join(list(dict.fromkeys(told))[:6]) or " ".join(longest(5).split())[:220])
    return out


def test_against_a_loop(spark):
    villages = [("Mina3", "agua", 1), ("Mina3", "polo", 0), ("Mina129", "rio", 0), ("Mina70", "nada", 0)]
    data = rows(1)
    got = mined.mined_cases(spark.createDataFrame(data, COLUMNS).repartition(4), CATALOGUE, None, villages=spark.createDataFrame(villages, "mina string, nombre string, orden int"))
    parse = lambda t: t[2:-2].split("', '") if t else []
    assert {r.caso_id: (parse(r.minas), parse(r.companias), r.tipo, r.departamento, r.caso, r.primera_fecha, r.ultima_fecha, r.n_meses, r.n_filas_panel, r.es_ilegal, r.es_socioambiental, r.pueblos) for r in got.collect()} == plain(data, villages)


def test_partner_summaries_and_missing_columns(spark):
    frame = spark.createDataFrame([(1, 1, "Antapaccay y Glencore"), (2, 2, "Antapaccay"), (3, 3, "nada"), (4, 4, None)], "caso_id int, pos int, caso string")
    told = spark.createDataFrame([("1", " Un resumen "), ("2", " ")], "caso_id string, resumen string")
    got = {r.caso_id: r for r in mined.mined_cases(frame, summaries=told).collect()}
    assert set(got) == {1, 2} and L.PARTNER in got[1].companias and L.PARTNER not in got[2].companias
    assert (got[1].resumen, got[1].fuente_resumen, got[2].fuente_resumen) == ("Un resumen", "modelo", "extractivo_caso")
    assert got[1].completo == 0 and got[1].primera_fecha == "" and got[1].grupo == "Caso_1"
    assert mined.mined_cases(frame.filter("false")).count() == 0
