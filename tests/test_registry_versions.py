"""Heading rewrites, exact samples, versions of a registry, the audit, one file a document, users' detectors, composition, number scan."""
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from citegrove.functions.numbers import numbers
from citegrove.operators import audit, extract, prepare, registry, stress, variants
from citegrove.plans.verify import index_tables
from citegrove.sources import files, result_files

COLUMNS = "id long, documento_id string, tribunal string, natureza string, ano int, relator string, texto string"


def raw(spark, rows):
    return spark.createDataFrame([(i, f"d{i}", c, n, None, None, t) for i, c, n, t in rows], COLUMNS)


def test_longest_heading_rule_holds(spark):
    reg = raw(spark, [(1, "STJ", "sumula", "Súmula 21\nA"), (2, "STJ", "sumula", "Súmula 211\nB"), (3, None, "acordao", "Súmula 21 citada"),
                      (4, "STJ", None, "Súmula 21 do STJ\nC"), (5, "STJ", "sumula", "Outra"), (6, "STJ", "sumula", None)])
    rules = spark.createDataFrame([("Súmula 21", "Enunciado 21"), ("Súmula 21 do STJ", None), ("Outra", "Nova"), ("", "x")], "old string, new string")
    added = raw(spark, [(9, "STJ", "sumula", "Súmula 7")])
    kept, gone = variants.rewrite_headings(reg, rules, added)
    assert {r.id: r.texto for r in kept.collect()} == {1: "Enunciado 21\nA", 2: "Súmula 211\nB", 3: "Súmula 21 citada", 5: "Nova", 6: None, 9: "Súmula 7"}
    assert [(r.old_id, r.new_id) for r in gone.collect()] == [(4, None)]
    assert kept.columns == reg.columns


@pytest.mark.parametrize("count", [0, 1, 7, 250, 999, 1000, 5000])
def test_exact_sample(spark, count):
    ids = spark.range(1000).withColumnRenamed("id", "x").select((F.col("x") * 17 + 3).alias("id"))
    got = sorted(r.id for r in variants.smallest_by_hash(ids, count, seed=5).collect())
    every = sorted((r.id for r in ids.collect()), key=lambda i: ((i * 7919 + 5) % 1_000_003, i))
    assert got == sorted(every[:count])
    assert variants.smallest_by_hash(ids.filter("false"), 3).count() == 0


def test_versions_parse_changed_rows_only(spark):
    base = raw(spark, [(1, "STJ", "acordao", "RECURSO ESPECIAL Nº 1.234.567 - PR x"), (2, "STJ", "acordao", "HABEAS CORPUS Nº 2.222.222 - SP y"),
                       (3, "STJ", "sumula", "Súmula n. 7 do STJ\nz")])
    built = registry.build_registry(base)
    new = base.withColumn("texto", F.when(F.col("id") == 3, "Súmula n. 8 do STJ\nz").otherwise(F.col("texto"))).unionByName(raw(spark, [(4, None, "sumula", "Súmula Vinculante 10\nw")]))
    changed = variants.changed_rows(base, new)
    assert sorted(r.id for r in changed.collect()) == [3, 4]
    ids = spark.createDataFrame([(i, 100 + i) for i in range(1, 5)], "old_id long, new_id long")
    tables = variants.version_tables(built, spark.createDataFrame([(2,)], "id long"), registry.build_registry(changed), ids)
    assert [(r.id, r.number, r.documento_id) for r in tables["decisions"].collect()] == [(101, "1234567", "reg_101")]
    assert {r.id: r.norm_key for r in tables["norms"].collect()} == {103: "sumula|STJ|false|8", 104: "sumula|STF|true|10"}


def test_audit_has_all_outcomes(spark):
    base = raw(spark, [(1, "STJ", "acordao", "RECURSO ESPECIAL Nº 1.234.567 - PR a"), (2, "STJ", "acordao", "HABEAS CORPUS Nº 1.234.567 - SP b"),
                       (3, "STJ", "acordao", "HABEAS CORPUS Nº 555.111 - SP c")])
    tables = index_tables(registry.build_registry(base))
    gold = spark.createDataFrame([("a", "HC 555.111/SP", "real", "3"), ("b", "REsp 1.234.567/PR", "real", "1"), ("c", "o de nº 1.234.567", "real", "2"),
                                  ("d", "HC 999.999", "real", "3"), ("e", "HC 999.999", "inventada", None), ("f", "HC 555.111", "inventada", None),
                                  ("g", "Súmula 7 do STJ", "real", "9"), ("h", "sem número", "real", "1"), ("i", None, "real", "1")],
                                 "row string, snippet string, label string, id string")
    got = {r.row: (r.outcome, r.by_number, r.at_the_end) for r in audit.registry_vs_gold_audit(gold, tables["numbers"], tables["profiles"], tables["pairs"]).collect()}
    assert {k: v for k, v in got.items() if k != "i"} == {
        "a": ("real_unique", 1, 1), "b": ("real_by_tiebreak", 2, 1), "c": ("real_ambiguous", 2, 2), "d": ("real_not_found", 0, 0),
        "e": ("invented_empty", 0, 0), "f": ("invented_with_candidate", 1, 1), "h": ("real_not_found", 0, 0)}


def test_one_file_a_document(spark, tmp_path):
    ids = ["plain", "a/b", "50%", "x+y z", ".hidden", "_under", "ação", "%2F", "a%2Fb"]
    rows = spark.createDataFrame([(i, '{"schema_version":"1.2","citacoes":[]}') for i in ids], "doc_id string, json string").repartition(3)
    folder = str(tmp_path / "out")
    result_files.write_result_files(rows, folder)
    back = files.read_result_json(spark, folder, one_per_file=True, encoded_names=True)
    assert sorted(r.documento_id for r in back.collect()) == sorted(ids)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")) == sorted(result_files.file_name(i) for i in ids)
    result_files.write_result_files(rows.filter("doc_id = '50%'"), folder, overwrite=True)
    assert [r.documento_id for r in files.read_result_json(spark, folder, True, True).collect()] == ["50%"]
    with pytest.raises(Exception, match="one id"):
        result_files.write_result_files(rows.unionByName(rows), folder)
    with pytest.raises(Exception, match="without id"):
        result_files.write_result_files(rows.withColumn("doc_id", F.lit(None).cast("string")), folder)
    assert len(files.read_result_json(spark, folder, True, True).collect()) == 1


def test_failing_detector_loses_its_spans_only(spark):
    def find(text):
        if "ruim" in text:
            raise ZeroDivisionError("x")
        if "fora" in text:
            return [(0, 999, "k")]
        return [(0, 2, "k")]
    docs = spark.createDataFrame([("a", "ok e REsp 1.741.784/PR"), ("b", "ruim e Tema 5"), ("c", "fora"), ("d", None), ("e", "")], "doc_id string, text string")
    spans, failed = extract.extract_isolated(docs, [extract.CustomDetector("own", 50, find), extract.CustomDetector("none", 51, lambda t: [])])
    assert sorted((r.doc_id, r.kind) for r in spans.collect()) == [("a", "acordao"), ("a", "k"), ("b", "tema")]
    assert sorted((r.doc_id, r.detector, r.error) for r in failed.collect()) == [("b", "own", "ZeroDivisionError"), ("c", "own", "ValueError"), ("e", "own", "ValueError")]


def test_composition_same_as_the_standard(spark):
    r = random.Random(3)
    parts = ["aeioucsyЙйиІअनकαωΩשבサハ각하한xz", "̸़゙゚ִּ̧̛̣̀́̂̃̈̌̆͂̓̈́", "áếặǖåÅΩ豈क़יִẛ",
             "".join(map(chr, [0x1100, 0x1112, 0x1161, 0x1175, 0x11a8, 0x11c2, 0xac00, 0xac01]))]
    texts = ["".join(r.choice(r.choice(parts)) for _ in range(r.randint(0, 25))) for _ in range(800)]
    rows = prepare.prepare_text(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for x in rows:
        assert x.prepared == unicodedata.normalize("NFC", x.text)
        if x.map_start is not None:
            assert len(x.map_start) == len(x.prepared) == len(x.map_end)
            assert all(a < b for a, b in zip(x.map_start, x.map_end, strict=True))


CASES = {"1.741.784/PR": ["1.741.784"], "nº1.234 e n.785.562": ["1.234", "785.562"], "109.956PR": ["109.956"], "ARR-1099-55.2010.5.01.0075": ["1099-55.2010.5.01.0075"],
         "RE 1.492.256-AgR": ["1.492.256"], "SS 2.888": ["2.888"], "nº SS. 413": ["SS. 413"], "1 2 Sl 698": ["1 2 Sl 698"], "2.O2 O. 005": ["2.O2 O. 005"],
         "l. 718.894": ["l. 718.894"], "o 12": ["12"], "12 o 13": ["12", "13"], "12, 13; (14)": ["12", "13", "14"], "x12 12x": [], "12.-": ["12"], "l S O": [], "": []}


def test_number_scan(spark):
    df = spark.createDataFrame(list(enumerate(CASES)) + [(99, None)], "i int, text string")
    got = {r.text: [x.match for x in r.n or []] for r in df.select("text", numbers(F.col("text")).alias("n")).collect()}
    assert got == {**CASES, None: []}


def test_failures_sample_is_bounded(spark):
    judged = spark.createDataFrame([(f"c{i}", "s", str(i % 2), "falhou" if i % 3 else "certo", False) for i in range(300)], "doc_id string, section string, form string, verdict string, severe boolean")
    known = judged.select("doc_id", F.lit("t").alias("text"), F.lit("real").alias("label"), F.lit("1").alias("id"))
    got = stress.failures_sample(judged, known, most=4, salts=3)
    assert sorted((r.form, r["rank"]) for r in got.collect()) == [(f, k) for f in "01" for k in range(1, 5)]
    assert got.filter("verdict = 'certo'").count() == 0
