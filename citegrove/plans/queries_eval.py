"""Queries over evaluation and result formats."""
import uuid

from pyspark.sql import DataFrame, functions as F

from citegrove.operators import audit, evaluate as E, resolve as S, results
from citegrove.plans import corpora as C
from citegrove.plans.queries_core import _RESOLVED, cited_spans, index, joined, query
from citegrove.plans.tables import shared_folder, stored
from citegrove.rules import CONFIDENCE
from citegrove.sources import files, result_files

_H = "(slot * 3 + span_start + level) % 10"
FIXTURE = f""",
base AS (SELECT *, {_H} AS h FROM truth),
gold AS (SELECT doc_id, level, slot AS idx, span_start AS s, span_end AS e, label, CAST(id AS STRING) AS id FROM base),
pred AS (SELECT doc_id, slot AS idx, span_start + CASE WHEN h = 1 THEN 2 ELSE 0 END AS s, span_end AS e,
    CASE WHEN h <> 2 THEN label WHEN label = 'inventada' THEN 'real' ELSE 'inventada' END AS label,
    CASE WHEN h = 2 THEN CASE WHEN label = 'inventada' THEN '123' END WHEN h = 3 THEN CAST(id + 7 AS STRING)
      ELSE CAST(id AS STRING) END AS id, CASE WHEN h <> 6 THEN 0.5 + 0.05 * h END AS conf FROM base WHERE h <> 0
  UNION ALL SELECT doc_id, slot + 100, span_start + 3, span_start + 8, 'inventada', NULL, 0.7 FROM base
    WHERE h = 4 AND span_end - span_start > 20
  UNION ALL SELECT doc_id, slot + 200, span_end + 4, span_end + 9, 'incompleta', NULL, 0.6 FROM base
    WHERE h = 5 AND kind <> 'acordao')"""
SCORED = FIXTURE + """,
pairs AS (SELECT g.doc_id, g.idx AS gi, p.idx AS pi, (least(g.e, p.e) - greatest(g.s, p.s))
    / CAST((g.e - g.s) + (p.e - p.s) - (least(g.e, p.e) - greatest(g.s, p.s)) AS DOUBLE) AS iou
  FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e),
good AS (SELECT * FROM pairs WHERE iou >= 0.5),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gi ORDER BY iou DESC, pi) AS r FROM good) WHERE r = 1),
mm AS (SELECT m.doc_id, g.level, g.s, g.label AS gl, p.label AS pl, p.conf, g.label = p.label AND (g.label <> 'real' OR
    coalesce(g.id = p.id, false)) AS hit FROM m JOIN gold g ON m.doc_id = g.doc_id AND m.gi = g.idx
    JOIN pred p ON m.doc_id = p.doc_id AND m.pi = p.idx),
free AS (SELECT p.* FROM pred p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.pi = p.idx)),
extra AS (SELECT DISTINCT f.doc_id, f.idx FROM free f JOIN m ON f.doc_id = m.doc_id JOIN gold g ON g.doc_id = m.doc_id AND g.idx = m.gi
  WHERE (least(g.e, f.e) - greatest(g.s, f.s)) / CAST(f.e - f.s AS DOUBLE) >= 0.9),
missed AS (SELECT g.* FROM gold g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.gi = g.idx)),
spurious AS (SELECT f.*, d.level FROM free f JOIN (SELECT DISTINCT doc_id, level FROM gold) d ON f.doc_id = d.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM extra x WHERE x.doc_id = f.doc_id AND x.idx = f.idx)),
ev AS (SELECT level, gl AS label, 'tp' AS metric FROM mm WHERE hit
  UNION ALL SELECT level, pl, 'fp' FROM mm WHERE NOT hit UNION ALL SELECT level, gl, 'fn' FROM mm WHERE gl <> pl
  UNION ALL SELECT level, label, 'support' FROM gold UNION ALL SELECT level, label, 'fn' FROM missed
  UNION ALL SELECT level, label, 'fp' FROM spurious),
counts AS (SELECT level, label, count(CASE WHEN metric = 'tp' THEN 1 END) AS tp, count(CASE WHEN metric = 'fp' THEN 1 END) AS fp,
  count(CASE WHEN metric = 'fn' THEN 1 END) AS fn, count(CASE WHEN metric = 'support' THEN 1 END) AS support FROM ev GROUP BY level, label),
f1 AS (SELECT level, avg(CASE WHEN support > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END) AS macro_f1 FROM counts GROUP BY level),
brier AS (SELECT level, avg((conf - CASE WHEN hit THEN 1 ELSE 0 END) * (conf - CASE WHEN hit THEN 1 ELSE 0 END)) AS b,
  count(CASE WHEN gl = 'inventada' AND pl = 'real' THEN 1 END) AS severe FROM mm GROUP BY level),
inv AS (SELECT level, count(*) AS n FROM gold WHERE label = 'inventada' GROUP BY level),
lv AS (SELECT f1.level, macro_f1, severe / CAST(n AS DOUBLE) AS tau, macro_f1 * (1 - 0.5 * severe / CAST(n AS DOUBLE)) AS s,
  greatest(0.0, least(0.1, 0.1 * (1 - b))) AS bonus FROM f1 JOIN brier ON f1.level = brier.level JOIN inv ON inv.level = f1.level)"""


def scored(select: str, more: str = "") -> str:
    return C.duck(f"WITH {C.truth_sql()}{SCORED}{more} {select}")


def _frame(spark, sf, what: str) -> DataFrame:
    rows = C.from_truth(spark, sf, f"WITH truth AS (SELECT * FROM {{truth}}){FIXTURE} SELECT * FROM {what}")
    return rows.withColumnsRenamed({"s": "start", "e": "end"})


def gold_frame(spark, sf) -> DataFrame:
    g = _frame(spark, sf, "gold")
    return g.withColumn("ids", F.array_compact(F.array("id"))).drop("id")


def pred_frame(spark, sf) -> DataFrame:
    return _frame(spark, sf, "pred").withColumn("conf", F.col("conf").cast("double"))


def both(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Gold and predictions; both are projections of the written truth, as the metric reads them several times."""
    return gold_frame(spark, sf), pred_frame(spark, sf)


def events(spark, sf) -> DataFrame:
    g, p = both(spark, sf)
    return E.confusion_events(g, p, g.select("doc_id", "level").distinct())


@query("span_iou_join", scored("SELECT doc_id, gi AS gold_idx, pi AS pred_idx, iou FROM good"))
def span_iou_join(spark, sf):
    return E.span_iou_join(*both(spark, sf)).select("doc_id", "gold_idx", "pred_idx", "iou")


@query("match_one_to_one", scored("SELECT doc_id, gi AS gold_idx, pi AS pred_idx FROM m"))
def match_one_to_one(spark, sf):
    return E.match_one_to_one(*both(spark, sf)).select("doc_id", "gold_idx", "pred_idx")


@query("component_extra", scored("SELECT doc_id, idx FROM extra"))
def component_extra(spark, sf):
    g, p = both(spark, sf)
    return E.component_extra(g, p, E.match_one_to_one(g, p))


@query("confusion_counts", scored("SELECT * FROM counts"))
def confusion_counts(spark, sf):
    return E.confusion_counts(events(spark, sf))


@query("level_scores", scored("SELECT level, macro_f1, tau, s, bonus, s * (1 + bonus) AS score FROM lv"))
def level_scores(spark, sf):
    return E.level_scores(events(spark, sf))


@query("final_score", scored("SELECT sum(level * s * (1 + bonus)) / sum(level) AS final_score FROM lv"))
def final_score(spark, sf):
    return E.final_score(E.level_scores(events(spark, sf)))


@query("oracle_ceiling", "SELECT 1.1 AS final_score")
def oracle_ceiling(spark, sf):
    g = gold_frame(spark, sf)
    ev = E.confusion_events(g, E.oracle_predictions(g), g.select("doc_id", "level").distinct())
    return E.final_score(E.level_scores(ev))


def conflicts(spans: str, select: str = "SELECT doc_id, a.idx AS idx_a, b.idx AS idx_b FROM touching") -> str:
    """Pairs of overlapping spans of a document, found within one list per document."""
    return scored(select, f""",
lists AS MATERIALIZED (SELECT doc_id, list(struct_pack(idx := idx, s := s, e := e) ORDER BY idx) AS v FROM ({spans}) GROUP BY doc_id),
each AS (SELECT doc_id, v, unnest(v) AS a FROM lists),
touching AS (SELECT doc_id, a, unnest(list_filter(v, lambda b: b.idx > a.idx AND a.s < b.e AND b.s < a.e)) AS b FROM each)""")


@query("span_conflicts", conflicts("SELECT doc_id, idx, s, e FROM pred"))
def span_conflicts(spark, sf):
    return E.span_conflicts(pred_frame(spark, sf), None).select("doc_id", "idx_a", "idx_b")


@query("span_conflicts_by_iou", conflicts(
    "SELECT doc_id, idx, s, e FROM pred UNION ALL SELECT doc_id, idx + 1000, s + 6, e + 6 FROM gold",
    "SELECT * FROM (SELECT doc_id, a.idx AS idx_a, b.idx AS idx_b, (least(a.e, b.e) - greatest(a.s, b.s)) / CAST((a.e - a.s) + (b.e - b.s) "
    "- (least(a.e, b.e) - greatest(a.s, b.s)) AS DOUBLE) AS iou FROM touching) WHERE iou >= 0.5"))
def span_conflicts_by_iou(spark, sf):
    gold, pred = both(spark, sf)
    moved = gold.select("doc_id", F.col("idx") + 1000, F.col("start") + 6, F.col("end") + 6)
    return E.span_conflicts(pred.select("doc_id", "idx", "start", "end").union(moved))


@query("gold_conflicts", conflicts("SELECT doc_id, idx, s, e + CASE WHEN idx % 4 = 0 THEN 60 ELSE 0 END AS e FROM gold"))
def gold_conflicts(spark, sf):
    wide = gold_frame(spark, sf).withColumn("end", F.col("end") + F.when(F.col("idx") % 4 == 0, 60).otherwise(0))
    return E.span_conflicts(wide, None).select("doc_id", "idx_a", "idx_b")


@query("error_report", scored(
    "SELECT doc_id, s AS start, CASE WHEN gl = pl THEN 'LINK' ELSE 'CLASSE' END AS error, gl AS expected, pl AS predicted, "
    "CASE WHEN gl = 'inventada' AND pl = 'real' THEN 1 ELSE 0 END AS severe FROM mm WHERE NOT hit "
    "UNION ALL SELECT doc_id, s, 'FALTOU', label, NULL, 0 FROM missed UNION ALL SELECT doc_id, s, 'SOBROU', NULL, label, 0 FROM spurious"))
def error_report(spark, sf):
    r = E.error_report(*both(spark, sf))
    return r.withColumn("severe", F.col("severe").cast("int"))


@query("coverage_check", scored("SELECT DISTINCT doc_id FROM gold WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = gold.doc_id)"))
def coverage_check(spark, sf):
    return E.coverage_check(*both(spark, sf))


_RES = C.duck(f"WITH {C.truth_sql()}{_RESOLVED} ")


def resolved(spark, sf) -> DataFrame:
    out = S.resolve_spans(cited_spans(spark, sf), index(spark, sf))
    levels = C.table(spark, sf, "orders").select(
        F.concat(F.lit("doc_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("doc_id"),
        (1 + F.col("o_orderkey") % 2).alias("level")).distinct()
    return out.join(levels, "doc_id")


@query("situation_mix", _RES + "SELECT situation, count(CASE WHEN level = 1 THEN 1 END) AS level_1, count(CASE WHEN level = 2 THEN 1 END) AS level_2 FROM res GROUP BY situation")
def situation_mix(spark, sf):
    return E.situation_mix(resolved(spark, sf))


_PROFILE = "(VALUES " + ", ".join(f"('{p}', '{s}', {c})" for p, t in CONFIDENCE.items() for s, c in t.items()) + ") AS pr(profile, situation, confidence)"


@query("accuracy_by_situation", _RES + f"SELECT pr.situation, count(res.label) AS n, avg(CASE WHEN res.label IS NOT NULL THEN 1.0 END) AS accuracy, "
       f"CAST(pr.confidence AS DOUBLE) AS confidence FROM {_PROFILE} LEFT JOIN res ON res.situation = pr.situation WHERE profile = 'padrao' GROUP BY pr.situation, pr.confidence")
def accuracy_by_situation(spark, sf):
    g = gold_frame(spark, sf).select("doc_id", F.col("start").alias("gs"), F.col("label").alias("gl"), F.col("ids"))
    r = resolved(spark, sf)
    hit = (F.col("label") == F.col("gl")) & ((F.col("gl") != "real") | F.coalesce(F.array_contains("ids", F.col("id").cast("string")), F.lit(False)))
    return E.accuracy_by_situation(r.join(g, (r["doc_id"] == g["doc_id"]) & (r["start"] == g["gs"])).select("situation", hit.alias("hit")))


@query("expected_brier", _RES + f"""
, mix AS (SELECT level, situation, count(*) AS k FROM res GROUP BY level, situation),
tot AS (SELECT level, sum(k) AS n, sum(CASE WHEN situation LIKE 'inventada%' THEN k ELSE 0 END) AS nr FROM mix GROUP BY level),
cs AS (SELECT mix.*, n, r.rate, md.model, pr.profile, pr.confidence AS c, CASE WHEN md.model = 'uniforme' THEN r.rate
   WHEN mix.situation LIKE 'inventada%' THEN least(1.0, r.rate * n / CAST(nr AS DOUBLE)) ELSE 0.0 END AS e
  FROM mix JOIN tot ON mix.level = tot.level JOIN {_PROFILE} ON pr.situation = mix.situation
  CROSS JOIN (VALUES (0.0), (0.005), (0.01), (0.02), (0.05), (0.10)) r(rate) CROSS JOIN (VALUES ('uniforme'), ('concentrado')) md(model)),
br AS (SELECT model, rate, profile, level, sum(k * ((1 - e) * (1 - c) * (1 - c) + e * c * c)) / max(n) AS b FROM cs GROUP BY model, rate, profile, level),
bo AS (SELECT model, rate, profile, sum(level * 0.1 * (1 - b)) / 3 AS bonus FROM br GROUP BY model, rate, profile)
SELECT bo.model, CAST(bo.rate AS DOUBLE) AS rate, bo.profile, CAST(bo.bonus AS DOUBLE) AS bonus, CAST(bo.bonus - u.bonus AS DOUBLE) AS gain
FROM bo JOIN bo u ON u.profile = 'um' AND u.model = bo.model AND u.rate = bo.rate""")
def expected_brier(spark, sf):
    mix = stored(E.situation_mix(resolved(spark, sf)), "mix")
    return E.expected_brier(mix, S.confidence_table(spark))


# ------------------------------------------------------------------ formats

_CELL = "CAST(span_start AS STRING) || ',' || CAST(span_end AS STRING) || ',' || label || ',' || coalesce(CAST(id AS STRING), '-')"
_DOCS = "(SELECT DISTINCT doc_id, level FROM sentences)"


def decided(spark, sf) -> DataFrame:
    return _frame(spark, sf, "base").withColumnsRenamed({"span_start": "start", "span_end": "end"}).withColumn(
        "confidence", F.when(F.col("h") != 6, 0.5 + 0.05 * F.col("h")))


def all_docs(spark, sf) -> DataFrame:
    return C.table(spark, sf, "orders").select(
        F.concat(F.lit("doc_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("doc_id")).distinct()


@query("encode_cells", scored(
    f"SELECT d.doc_id, coalesce(string_agg({_CELL} || ',' || CASE WHEN h = 6 THEN '-' ELSE printf('%.4f', 0.5 + 0.05 * h) END, '|' ORDER BY span_start), '-') AS cells "
    f"FROM {_DOCS} d LEFT JOIN base b ON d.doc_id = b.doc_id GROUP BY d.doc_id"))
def encode_cells(spark, sf):
    return results.encode_cells(all_docs(spark, sf), decided(spark, sf))


@query("gold_to_cells", scored(f"SELECT doc_id, level, string_agg({_CELL}, '|' ORDER BY span_start) AS cells FROM base GROUP BY doc_id, level"))
def gold_to_cells(spark, sf):
    return results.gold_to_cells(gold_frame(spark, sf))


@query("parse_prediction_cells", scored(
    "SELECT doc_id, s AS start, e AS end, label, id, CAST(conf AS DOUBLE) AS conf, '' AS errors FROM (SELECT doc_id, span_start AS s, span_end AS e, label, "
    "CAST(id AS STRING) AS id, CASE WHEN h <> 6 THEN 0.5 + 0.05 * h END AS conf FROM base) UNION ALL "
    "SELECT DISTINCT doc_id, CAST(9 AS BIGINT), CAST(4 AS BIGINT), 'real', NULL, CAST(1.5 AS DOUBLE), 'span|real_without_id|confidence_range' FROM sentences"))
def parse_prediction_cells(spark, sf):
    cells = results.encode_cells(all_docs(spark, sf), decided(spark, sf)).select("doc_id", F.concat(
        F.when(F.col("cells") == "-", "").otherwise(F.col("cells")), F.lit("| |9,4,REAL,-,1.5")).alias("cells"))
    p = E.parse_prediction_cells(cells)
    return p.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label", "id", "conf",
                    joined(F.col("errors")).alias("errors"))


@query("parse_gold_cells", scored("SELECT doc_id, span_start AS start, span_end AS end, label, coalesce(CAST(id AS STRING), '') AS ids, '' AS errors FROM base"))
def parse_gold_cells(spark, sf):
    p = E.parse_gold_cells(results.gold_to_cells(gold_frame(spark, sf)))
    return p.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label",
                    joined(F.col("ids")).alias("ids"), joined(F.col("errors")).alias("errors"))


@query("result_documents", scored(
    f"SELECT d.doc_id, count(b.doc_id) AS n, coalesce(string_agg('c' || CAST(r AS STRING) || ':' || CAST(span_start AS STRING) || ':' || label, '|' ORDER BY span_start), '') AS items "
    f"FROM {_DOCS} d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_start) AS r FROM base) b ON d.doc_id = b.doc_id GROUP BY d.doc_id"))
def result_documents(spark, sf):
    out = results.result_documents(all_docs(spark, sf), decided(spark, sf).withColumn("snippet", F.lit("x")), "registro")
    c = F.from_json("json", "schema_version string, documento_id string, citacoes array<struct<id:string,inicio:bigint,classificacao:string>>")["citacoes"]
    return out.select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("bigint").alias("n"), F.array_join(F.transform(
        "c", lambda x: F.concat_ws(":", x["id"], x["inicio"].cast("string"), x["classificacao"])), "|").alias("items"))


@query("stale_outputs", "SELECT 'doc_' || lpad(CAST(l_orderkey AS STRING), 12, '0') AS doc_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN "
       "(SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def stale_outputs(spark, sf):
    out = C.table(spark, sf, "lineitem").select(F.concat(F.lit("doc_"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("doc_id"))
    docs = C.table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(
        F.concat(F.lit("doc_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("doc_id"))
    return results.stale_outputs(out, docs).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("first_submission_row", "SELECT l_orderkey AS doc_id, min(l_partkey * 1000 + l_linenumber) AS row_no FROM lineitem GROUP BY 1")
def first_submission_row(spark, sf):
    d = C.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("row_no"))
    return E.first_submission_row(d)


@query("normalise_id", "SELECT l_orderkey, l_partkey, CAST(l_partkey AS STRING) AS id, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def normalise_id(spark, sf):
    d = C.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", E.normalise_id(F.concat(
        F.lit(" 00"), F.col("l_partkey").cast("string"), F.lit(" "))).alias("id"))
    return d.groupBy("l_orderkey", "l_partkey", "id").agg(F.count("*").alias("n"))


@query("number_citations", scored("SELECT doc_id, span_start AS start, 'c' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY span_start, span_end) AS STRING) AS cit_id FROM base"))
def number_citations(spark, sf):
    return S.number_citations(decided(spark, sf)).select("doc_id", F.col("start").cast("bigint").alias("start"), "cit_id")


# ------------------------------------------------------------------ round trips through files

# text with quotes, a comma and a line break, or none at all
_SNIPPET = """CASE slot % 4 WHEN 0 THEN 'diz "' || kind || '", e' WHEN 1 THEN kind || chr(10) || 'linha' WHEN 2 THEN NULL ELSE kind END"""


def _with_snippet(df: DataFrame) -> DataFrame:
    return df.withColumn("snippet", F.expr(_SNIPPET.replace("chr(10)", "char(10)")))


@query("result_json_roundtrip", scored(
    f"SELECT doc_id, 'c' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY span_start) AS STRING) AS cit, span_start, span_end, {_SNIPPET} AS snippet, "
    "CASE WHEN kind = 'artigo' THEN 'lei' ELSE 'jurisprudencia' END AS kind, label, CASE WHEN label = 'real' THEN 'registro' END AS source, "
    "CASE WHEN label = 'real' THEN CAST(id AS STRING) END AS id, CASE WHEN h <> 6 THEN CAST(0.5 + 0.05 * h AS DOUBLE) END AS confidence FROM base "
    f"UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {_DOCS} WHERE doc_id NOT IN (SELECT doc_id FROM base)"))
def result_json_roundtrip(spark, sf):
    folder = f"{shared_folder(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    files.write_result_json(results.result_documents(all_docs(spark, sf), _with_snippet(decided(spark, sf)), "registro"), folder)
    back = files.read_result_json(spark, folder)
    c = back.select(F.col("documento_id").alias("doc_id"), F.explode_outer("citacoes").alias("c"))
    return c.select("doc_id", F.col("c.id").alias("cit"), F.col("c.inicio").cast("bigint").alias("span_start"), F.col("c.fim").cast("bigint").alias("span_end"),
                    F.col("c.trecho").alias("snippet"), F.col("c.tipo").alias("kind"), F.col("c.classificacao").alias("label"),
                    F.col("c.resolucao.fonte").alias("source"), F.col("c.resolucao.id_canonico").alias("id"), F.col("c.confianca").alias("confidence"))


@query("result_files_roundtrip", scored(
    f"SELECT 'p/' || replace(d.doc_id, '_', '.%+') AS doc_id, count(b.doc_id) AS citations, count(CASE WHEN label = 'real' THEN 1 END) AS resolved "
    f"FROM {_DOCS} d LEFT JOIN base b ON d.doc_id = b.doc_id GROUP BY d.doc_id"))
def result_files_roundtrip(spark, sf):
    """One file a document; ids come back from the names of the files, whatever signs they hold."""
    folder = f"{shared_folder(spark).rstrip('/')}/result-files-{uuid.uuid4().hex}"
    out = results.result_documents(all_docs(spark, sf), _with_snippet(decided(spark, sf)), "registro")
    named = out.select(F.concat(F.lit("p/"), F.replace("doc_id", F.lit("_"), F.lit(".%+"))).alias("doc_id"),
                       F.regexp_replace("json", '"documento_id":"[^"]*",', "").alias("json"))
    result_files.write_result_files(named, folder)
    back = files.read_result_json(spark, folder, one_per_file=True, encoded_names=True)
    return back.select(F.col("documento_id").alias("doc_id"), F.size("citacoes").cast("bigint").alias("citations"),
                       F.size(F.filter("citacoes", lambda c: c["resolucao"]["id_canonico"].isNotNull())).cast("bigint").alias("resolved"))


@query("gold_csv_roundtrip", scored(
    f"SELECT doc_id, CASE WHEN slot % 3 <> 0 THEN CAST(level AS INTEGER) END AS level, 'c' || CAST(slot AS STRING) AS cit, CAST(span_start AS INTEGER) AS span_start, "
    f"CAST(span_end AS INTEGER) AS span_end, coalesce({_SNIPPET}, '') AS snippet, label, coalesce(CAST(id AS STRING), '') AS id FROM base"))
def gold_csv_roundtrip(spark, sf):
    path = f"{shared_folder(spark).rstrip('/')}/gold-{uuid.uuid4().hex}"
    files.write_gold_csv(_with_snippet(decided(spark, sf)).select(
        F.col("doc_id").alias("documento_id"), F.when(F.col("slot") % 3 != 0, F.col("level")).alias("nivel"),
        F.concat(F.lit("c"), F.col("slot").cast("string")).alias("citacao_id"), F.col("start").alias("inicio"), F.col("end").alias("fim"),
        F.col("snippet").alias("trecho"), F.col("label").alias("classificacao"), F.col("id").alias("id_canonico")), path)
    return files.read_gold_csv(spark, path).select(
        F.col("documento_id").alias("doc_id"), F.col("nivel").alias("level"), F.col("citacao_id").alias("cit"), F.col("inicio").alias("span_start"),
        F.col("fim").alias("span_end"), F.col("trecho").alias("snippet"), F.col("classificacao").alias("label"), F.col("id_canonico").alias("id"))


# ------------------------------------------------------------------ registry against gold

# citations whose class does not read, is taken away or is that of the namesake too; whose label or id is wrong
_WRONG = "CAST((span_start + level + slot) % 7 AS INT)"
_AUDITED = f"""SELECT b.doc_id, b.slot, {_WRONG.replace('span_start', 'b.span_start').replace('level', 'b.level').replace('slot', 'b.slot')} AS wrong, b.label, b.id, b.t,
  CASE WHEN b.slot % 2 = 1 THEN p.txt_u ELSE p.txt END AS snippet, b.slot % 2 = 1 AS bare, p.level = 2 AND p.v % 2 = 1 AND p.digits AS damaged
  FROM truth b JOIN (SELECT doc_id, i * 2 AS slot, level, v, coalesce(head, cite) AS txt, substr(cite, length(head) + 4) AS txt_u,
    length(translate(noisy_name, '01', '')) < length(noisy_name) AS digits FROM placed) p ON p.doc_id = b.doc_id AND p.slot = b.slot - b.slot % 2 WHERE b.kind = 'acordao'"""
_GOLD_AUDITED = f"""SELECT concat_ws('|', doc_id, CAST(slot AS STRING)) AS row, CASE WHEN wrong = 2 THEN substr(snippet, {{first_digit}}) ELSE snippet END AS snippet,
  CASE WHEN wrong = 0 AND label = 'real' THEN 'inventada' ELSE label END AS label, CAST(CASE WHEN wrong = 1 THEN id + 7 ELSE id END AS STRING) AS id FROM ({_AUDITED}) x"""


@query("registry_vs_gold_audit", C.duck(f"""WITH {C.truth_sql()}, audited AS ({_AUDITED}),
counted AS (SELECT *, CASE WHEN label <> 'real' THEN 0 ELSE 1 + CASE WHEN t % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN t % 13 = 0 THEN 1 ELSE 0 END END AS records FROM audited)
SELECT outcome, count(*) AS citations, CAST(sum(records) AS BIGINT) AS by_number FROM (SELECT records, CASE WHEN label <> 'real' THEN 'invented_empty' WHEN wrong = 0 THEN 'invented_with_candidate'
  WHEN wrong = 1 THEN 'real_not_found' WHEN t % 11 = 0 AND (wrong = 2 OR damaged OR (t % 5 = 4 AND {C.idiv('t', 5)} % 4 = 3)) THEN 'real_ambiguous' WHEN records > 1 THEN 'real_by_tiebreak' ELSE 'real_unique' END AS outcome FROM counted)
GROUP BY outcome"""))
def registry_vs_gold_audit(spark, sf):
    first_digit = "length(regexp_extract(snippet, '^([^0-9]*)', 1)) + 1"
    gold = C.run_filings(spark, sf, f"WITH {C.truth_sql(True)} " + _GOLD_AUDITED.replace("{first_digit}", first_digit), "orders", "part")
    b = index(spark, sf)
    found = audit.registry_vs_gold_audit(stored(gold, "audited"), b["numbers"], b["profiles"], b["pairs"])
    return found.groupBy("outcome").agg(F.count("*").alias("citations"), F.sum("by_number").cast("bigint").alias("by_number"))
