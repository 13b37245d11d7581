"""Small fixtures with known answers, and the registered queries against their SQL."""
import pytest
from pyspark.sql import functions as F

from citegrove.functions import classes, courts, dockets, laws
from citegrove.operators import evaluate, extract
from citegrove.sources import files

SF = "/root/testdata/sf0.001"


def found(spark, text):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = extract.extract_all(df).orderBy("start").collect()
    return [(text[r["start"]:r["end"]], r) for r in rows]


@pytest.mark.parametrize("raw, number", [
    ("1.996.496", "1996496"), ("1.528.4S5", "1528455"), ("65-63.2010.5.01.0075", "0000065-63.2010.5.01.0075"),
    ("000", "0"), ("ace", None)])
def test_canonical_docket(spark, raw, number):
    row = spark.createDataFrame([(raw,)], "v string").select(dockets.canonical_docket(F.col("v")).alias("n")).first()
    assert row["n"] == number


@pytest.mark.parametrize("raw, acronyms", [
    ("AgInt no AGRAVO EM RECURSO ESPECIAL", ["AgInt", "AREsp"]), ("Rec. Esp.", ["REsp"]), ("TST-ED-E-ED-RR", ["ED", "E", "ED", "RR"]),
    ("Rec1amação", ["Rcl"]), ("Apelação Crirninal", ["Apl"]), ("A.REsp", ["AREsp"])])
def test_canonical_class(spark, raw, acronyms):
    row = spark.createDataFrame([(raw,)], "v string").select(classes.canonical_class(F.col("v")).alias("c")).first()
    assert row["c"] == acronyms


def test_laws_and_courts(spark):
    df = spark.createDataFrame([("Constituição Fedcral, e", "Superi0r Tribunal de Justiça"), ("CPC/2015.", "5TJ")], "law string, court string")
    rows = df.select(laws.read_law(F.col("law"))["code"].alias("l"), courts.court_code(F.col("court")).alias("c")).collect()
    assert [(r["l"], r["c"]) for r in rows] == [("CF", "STJ"), ("L13105", "STJ")]


def test_citations_of_each_kind(spark):
    got = found(spark, "Confira-se o AgInt no AREsp nº 1.996.496/RJ e a Súmula 331 do TST, o art. 373, I, do CPC, o Tema 1.046 do STJ "
                       "e o julgado do STF proferido em 2024 pela relatoria de Dias Toffoli.")
    assert [(s, r["kind"]) for s, r in got] == [
        ("AgInt no AREsp nº 1.996.496/RJ", "acordao"), ("Súmula 331 do TST", "sumula"), ("art. 373, I, do CPC", "artigo"),
        ("Tema 1.046 do STJ", "tema"), ("julgado do STF proferido em 2024 pela relatoria de Dias Toffoli", "incompleta")]
    assert got[0][1]["number"] == "1996496" and got[0][1]["class"] == ["AgInt", "AREsp"] and got[0][1]["uf"] == "RJ"
    assert got[1][1]["norm_key"] == "sumula|TST|false|331" and got[2][1]["norm_key"] == "artigo|L13105|373"


def test_enumeration_and_suffix(spark):
    got = found(spark, "Nesse sentido: REsp 1.741.784/PR e 1.996.496/RJ; RE 1.492.256-AgR-EDv, todos citados.")
    assert [(s, r["class"]) for s, r in got] == [
        ("REsp 1.741.784/PR", ["REsp"]), ("1.996.496/RJ", ["REsp"]), ("RE 1.492.256-AgR-EDv", ["EDiv", "AgRg", "RE"])]


@pytest.mark.parametrize("text", [
    "A perícia está às fls. 41/57. O laudo foi aceito.", "Autos nº 1234567-08.2021.4.03.6100",
    "assina a inicial a advogada (OAB/PR 51234), com procuração", "O débito soma R$ 98.310,05",
    "conforme a Lei nº 9.099/1995, em vigor", "Enunciado 8 da III Jornada de Direito Comercial",
    "nas safras de 2016 e 2017", "Portaria TSE nº 112.310/2022"])
def test_distractors(spark, text):
    assert found(spark, text) == []


def test_matching_ties(spark):
    gold = spark.createDataFrame([("d", 0, 0, 5), ("d", 1, 5, 10)], "doc_id string, idx int, start int, end int")
    pred = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 5, 9)], "doc_id string, idx int, start int, end int")
    got = {(r["gold_idx"], r["pred_idx"]) for r in evaluate.match_one_to_one(gold, pred).collect()}
    assert got == {(1, 1), (0, 0)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"linha\r\nfim")
    (tmp_path / "b.TXT").write_bytes(b"ruim \xff aqui")
    (tmp_path / "c.pdf").write_bytes(b"x")
    rows = {r["doc_id"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["text"] == "linha\r\nfim" and not rows["b"]["utf8_ok"]


def test_queries_match_their_sql(spark):
    import compare
    from citegrove.plans import catalogue
    con = compare.duck(SF)
    names = ["standardize_dockets", "extract_dockets", "registry_numbers", "resolve_spans", "confusion_counts", "encode_cells"]
    for name in names:
        ok, message = compare.compare(spark, con, SF, name, catalogue.QUERIES[name], catalogue.ORACLES[name])
        assert ok, (name, message)
