"""Queries over normalisation, extraction, registry and resolution, each with the SQL that knows the answer."""
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegrove.functions import classes, courts, dockets, laws, text as tx
from citegrove.functions.spans import slice_text
from citegrove.operators import extract as X, prepare, registry as R, resolve as S
from citegrove.operators.normalize import law_codes_by_ratio, repair_words
from citegrove.plans import corpora as C
from citegrove.plans.verify import index_tables, verify
from citegrove.plans.tables import once

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def sentences(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Sentences of the filings with what they were made of."""
    table = once(spark, sf, "sentences", lambda: C.run_filings(
        spark, sf, f"WITH {C.filing_steps(True)} SELECT * FROM sentences"))
    return table.selectExpr(*columns)


def duck_sentences(select: str) -> str:
    return C.duck(f"WITH {C.filing_steps()} {select}")


def joined(arr: Column) -> Column:
    return F.array_join(arr, "|")


NUMBER = "CASE WHEN t % 5 < 2 THEN CAST(plain AS STRING) ELSE cnj END"
DIGITS = "regexp_replace(translate(num, 'OoQDlLIi|!SsgqGbBZz', '0000111111559966822'), '[^0-9]', '', 'g')"


@query("standardize_dockets", duck_sentences(
    f"SELECT doc_id, i, {DIGITS} AS digits, {NUMBER} AS number, CASE WHEN t % 5 >= 2 THEN 1 ELSE 0 END AS cnj, "
    "CASE WHEN t % 5 >= 2 THEN CAST(justice AS STRING) END AS segment, CASE WHEN t % 5 >= 2 THEN 1 ELSE 0 END AS check_ok "
    "FROM sentences"))
def standardize_dockets(spark, sf):
    n = sentences(spark, sf, "doc_id", "i", "num").withColumn("number", dockets.canonical_docket(F.col("num")))
    return n.select("doc_id", "i", dockets.repair_digits(F.col("num")).alias("digits"), "number",
                    dockets.is_cnj(F.col("number")).cast("int").alias("cnj"),
                    dockets.cnj_segment(F.col("number")).alias("segment"),
                    dockets.cnj_check_ok(F.col("number")).cast("int").alias("check_ok"))


@query("strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents UNION ALL "
       "SELECT conv_id * 1000 + turn, md5(strip_accents(text)) FROM conversations")
def strip_accents(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id", "text")
    c = C.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return d.union(c).select("doc_id", F.md5(tx.strip_accents(F.col("text"))).alias("plain"))


@query("collapse_spaces", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{00A0}\x{0085}\x{2028}\x{2029}]+', ' ', 'g'))) AS one_line, "
       "CAST(length(text) AS BIGINT) AS n FROM documents")
def collapse_spaces(spark, sf):
    return C.table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.collapse_spaces(F.col("text"))).alias("one_line"), F.length("text").cast("bigint").alias("n"))


# invisible signs, and text in other forms: reordered marks, Cyrillic, Hangul in parts, signs with a canonical twin
_FORMS = "и\u0306 e\u0302\u0323 \u1112\u1161\u11ab \u212b\u2126"
_INJECT = "replace(replace(replace(replace(text, ' l', ' \u200bl'), '. ', '. \u2014\u201c '), ', e', ', \u2019e\u0301'), ', a', ', " + _FORMS + " a')"


@query("prepare_text", f"""
WITH src AS (SELECT doc_id, {_INJECT} AS t FROM documents),
out AS (SELECT doc_id, t, nfc_normalize(translate(replace(replace(t, '​', ''), '­', ''),
  '‐‑‒–—―−﹣－“”„‘’´', '---------""" + '"""' + """''''''')) AS p FROM src)
SELECT doc_id, md5(p) AS prepared, CAST(length(p) AS BIGINT) AS n,
  CASE WHEN regexp_matches(t, '[\u200b\u00ad]|\\p{M}') THEN 1 ELSE 0 END AS mapped FROM out
""".replace("''''''')) AS p", "''''''')) AS p"))
def prepare_text(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id", F.expr(_INJECT).alias("t"))
    p = prepare.prepare_text(d, "t")
    return p.select("doc_id", F.md5("prepared").alias("prepared"), F.length("prepared").cast("bigint").alias("n"),
                    F.col("map_start").isNotNull().cast("int").alias("mapped"))


@query("standardize_classes", duck_sentences(
    "SELECT doc_id, i, acr AS class, list_extract(string_split(acr, '|'), -1) AS base, 1 AS known FROM sentences"))
def standardize_classes(spark, sf):
    n = sentences(spark, sf, "doc_id", "i", "name").select(
        "doc_id", "i", "name", F.explode(F.array(classes.canonical_class(F.col("name")))).alias("c"))
    return n.select("doc_id", "i", joined(F.col("c")).alias("class"), classes.base_class(F.col("c")).alias("base"),
                    classes.known_word(F.col("name")).cast("int").alias("known"))


# words of the class vocabulary, one of them damaged per order
_WORDS = ["RECURSO", "ESPECIAL", "AGRAVO", "EMBARGOS", "MANDADO", "SEGURANCA", "RECLAMACAO", "COMPETENCIA",
          "INSTRUMENTO", "REGIMENTAL", "ELEITORAL", "ORDINARIO", "CONFLITO", "LIMINAR", "DECLARACAO", "CRIMINAL",
          "JURISDICAO", "CORREICAO", "PRESTACAO"]
_WORD = C.pick("o_orderkey", C.quoted(_WORDS))
_DAMAGED = (f"CASE o_orderkey % 4 WHEN 0 THEN replace(w, 'O', '0') WHEN 1 THEN replace(w, 'L', '1') "
            f"WHEN 2 THEN replace(w, 'M', 'RN') ELSE replace(w, 'ES', 'E5') END")


@query("repair_words", f"WITH a AS (SELECT o_orderkey, {_WORD} AS w FROM orders), b AS (SELECT {_DAMAGED} AS word, w, "
       f"length(w) - length(replace(w, 'O', '')) AS o FROM a) SELECT word, CASE WHEN contains(word, '0') AND o > 2 "
       f"THEN word ELSE max(w) END AS repaired, count(*) AS n FROM b GROUP BY word, o")
def repair_words_query(spark, sf):
    w = C.table(spark, sf, "orders").select("o_orderkey", F.expr(_WORD).alias("w")).select(F.expr(_DAMAGED).alias("word"))
    return repair_words(w, "word").groupBy("word", "repaired").agg(F.count("*").alias("n"))


_LAW_TEXT = C.pick(C.idiv("j", 4), [C.pick("k + i + v", C.quoted([n[3:] for n in names])) for _, _, names in C.LAWS])


@query("standardize_laws", duck_sentences(
    f"SELECT doc_id, i, {C.norm_law('j')} AS code, {C.norm_law('j')} AS by_heading, CAST(length({_LAW_TEXT}) AS BIGINT) AS used "
    "FROM sentences"))
def standardize_laws(spark, sf):
    heading = C.pick(C.idiv("j", 4), C.quoted([law[1] for law in C.LAWS]))
    n = sentences(spark, sf, "doc_id", "i", f"{_LAW_TEXT} AS law_text", f"{heading} AS heading").select(
        "*", F.explode(F.array(laws.read_law(F.concat("law_text", F.lit(", que rege o caso"))))).alias("law"))
    return n.select("doc_id", "i", F.col("law.code").alias("code"),
                    laws.law_code_from_description(F.col("heading")).alias("by_heading"),
                    F.col("law.length").cast("bigint").alias("used"))


_LONG_NAMES = [("Código de Processo Civil", "L13105"), ("Consolidação das Leis do Trabalho", "DL5452"),
               ("Constituição Federal", "CF"), ("Código de Defesa do Consumidor", "L8078"), ("Código Eleitoral", "L4737"),
               ("Estatuto da Criança e do Adolescente", "L8069"), ("Código de Processo Penal Militar", "DL1002"),
               ("Marco Civil da Internet", "L12965")]
_NAME_DAMAGED = ("CASE o_orderkey % 3 WHEN 0 THEN nm WHEN 1 THEN substr(nm, 1, 4) || 'x' || substr(nm, 6) "
                 "ELSE substr(nm, 1, length(nm) - 2) || substr(nm, length(nm)) END")
_NAMED = (f"SELECT o_orderkey, {C.pick('o_orderkey', C.quoted([n for n, _ in _LONG_NAMES]))} AS nm, "
          f"{C.pick('o_orderkey', C.quoted([c for _, c in _LONG_NAMES]))} AS code FROM {{orders}}")


@query("law_alias_fuzzy", C.duck(f"WITH a AS ({_NAMED}) SELECT o_orderkey AS k, code FROM a"))
def law_alias_fuzzy(spark, sf):
    d = C.run_sql(spark, sf, f"WITH a AS ({_NAMED}) SELECT o_orderkey AS k, {_NAME_DAMAGED} AS nm FROM a", "orders")
    return d.select("k", laws.law_code_from_name(F.concat("nm", F.lit(". Assim")))["code"].alias("code"))


# nothing, two neighbours exchanged, two or three letters damaged
_NAME_WORN = ("CASE o_orderkey % 4 WHEN 0 THEN nm WHEN 1 THEN substr(nm, 1, 3) || substr(nm, 5, 1) || substr(nm, 4, 1) || substr(nm, 6) "
              "WHEN 2 THEN substr(nm, 1, 4) || 'x' || substr(nm, 6, 8) || 'x' || substr(nm, 15) "
              "ELSE substr(nm, 1, 1) || 'x' || substr(nm, 3, 2) || 'x' || substr(nm, 6, 8) || 'x' || substr(nm, 15) END")


@query("law_codes_by_ratio", C.duck(
    f"WITH a AS ({_NAMED}), b AS (SELECT *, length(replace(nm, 'rn', 'm')) AS n FROM a) SELECT o_orderkey AS k, CASE WHEN (n - CAST(o_orderkey % 4 AS DOUBLE)) / n >= 0.9 "
    "OR o_orderkey % 4 = 0 THEN code END AS law_code FROM b"))
def law_codes_by_ratio_query(spark, sf):
    d = C.run_sql(spark, sf, f"WITH a AS ({_NAMED}) SELECT o_orderkey AS k, {_NAME_WORN} AS nm FROM a", "orders")
    return law_codes_by_ratio(d, "nm").select("k", "law_code")


_COURT_TEXT = C.pick("o_orderkey", C.quoted([C.COURT_NAMES[c] for c in C.COURT_ORDER]))
_STATE_NAMES = [k for k in C.STATES]
_RAPP_FORMS = C.pick("o_orderkey", C.quoted(["Min. ", "Ministra ", "Des. ", "Desembargador ", "", "ministro "]))
_PARTY_SRC = (f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN replace({_COURT_TEXT}, 'o', '0') ELSE {_COURT_TEXT} END "
              f"AS court_text, lower({C.pick('o_orderkey', C.quoted(_STATE_NAMES))}) AS state_text, "
              f"CASE WHEN o_orderkey % 9 = 0 THEN 'Min. relator' ELSE {_RAPP_FORMS} || {C.pick('o_orderkey', C.quoted(C.RAPPORTEURS))} "
              f"END AS rapp_text FROM {{orders}}")


@query("standardize_parties_and_courts", C.duck(
    f"SELECT o_orderkey AS k, {C.pick('o_orderkey', C.quoted(C.COURT_ORDER))} AS court, "
    f"{C.pick('o_orderkey', C.quoted([C.STATES[s] for s in _STATE_NAMES]))} AS uf, CASE WHEN o_orderkey % 9 <> 0 THEN "
    f"{C.pick('o_orderkey', C.quoted(C.RAPPORTEURS))} END AS rapporteur FROM orders"))
def standardize_parties_and_courts(spark, sf):
    d = C.run_sql(spark, sf, _PARTY_SRC, "orders")
    return d.select("k", courts.court_code(F.col("court_text")).alias("court"), courts.state_code(F.col("state_text")).alias("uf"),
                    courts.normalise_rapporteur(F.col("rapp_text")).alias("rapporteur"))


_LETTER = "a-zA-ZÀ-ÖØ-öø-ÿ"


@query("noise_flag", duck_sentences(
    "SELECT doc_id, i, CASE WHEN regexp_matches(cite, '\\n|\\d\\s+\\d|\\d\\s*[.\\-]\\s+\\d|\\d[.\\-]\\s*[.\\-]|"
    f"\\d[b-np-zA-ZÀ-ÖØ-öø-ÿ]|[{_LETTER}]\\d|(?:^|[^{_LETTER}0-9_ºª])[OlLISBGZ5]{{{{1,3}}}}\\.?\\s+\\d') "
    "THEN 1 ELSE 0 END AS noisy FROM sentences"))
def noise_flag(spark, sf):
    return sentences(spark, sf, "doc_id", "i", "cite").select("doc_id", "i", tx.noise_flag(F.col("cite")).cast("int").alias("noisy"))


# ------------------------------------------------------------------ extraction

@query("scan_numbers", duck_sentences("SELECT doc_id, i, CAST(6 AS BIGINT) AS span_start, CAST(6 + length(num) AS BIGINT) "
                                      "AS span_end FROM sentences"))
def scan_numbers(spark, sf):
    n = sentences(spark, sf, "doc_id", "i", "'Autos ' || num || ' fim' AS text")
    return X.scan_numbers(n).select("doc_id", "i", F.col("start").cast("bigint").alias("span_start"),
                                    F.col("end").cast("bigint").alias("span_end"))


# documents with a table of numbers and loose letters behind their own text; the first document of each language has long ones
_TABLE_SIZES = "WITH d AS (SELECT doc_id, text, CASE WHEN doc_id IN (SELECT min(doc_id) FROM {documents} GROUP BY lang) THEN 10000 ELSE 3 + doc_id % 20 END AS n FROM {documents})"
_FIRST, _LAST, _DIRT = "REsp 1.741.784/PR", "RE 1.492.256", ". Dito "
_TABLE, _HEAD = "Tabela: ", f"Consta o {_FIRST} desta lista: "


def _with_table(spark, sf, head: str) -> DataFrame:
    """doc_id, base (where the table's text begins), text."""
    d = C.run_sql(spark, sf, _TABLE_SIZES + " SELECT doc_id, coalesce(text, '') AS text, n FROM d", "documents")
    table = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: (j + 10_000).cast("string")), "; ")
    text = F.concat("text", F.lit("\n\n" + head), table, F.lit(_DIRT), F.expr("repeat('l. ', CAST(5 * n AS INT))"), F.lit("fim. Veja o " + _LAST + "."))
    return d.select("doc_id", F.length("text").alias("base"), text.alias("text"))


@query("scan_numbers_long", _TABLE_SIZES.format(documents="documents") + f" SELECT doc_id, {2 + len(_TABLE)} + 7 * j AS span_start, {7 + len(_TABLE)} + 7 * j AS span_end FROM (SELECT doc_id, unnest(range(0, n)) AS j FROM d) "
       f"UNION ALL SELECT doc_id, {len(_TABLE)} + 7 * n + {len(_DIRT)} + 15 * n + 15, {len(_TABLE)} + 7 * n + {len(_DIRT)} + 15 * n + 24 FROM d")
def scan_numbers_long(spark, sf):
    """Tables of up to 10,000 numbers and 50,000 loose letters; places are counted from the end of the document's own text."""
    found = X.scan_numbers(_with_table(spark, sf, _TABLE)).filter("start >= base")
    return found.select("doc_id", (F.col("start") - F.col("base")).cast("bigint").alias("span_start"), (F.col("end") - F.col("base")).cast("bigint").alias("span_end"))


@query("extract_all_long", _TABLE_SIZES.format(documents="documents") + f" SELECT doc_id, {2 + _HEAD.index(_FIRST)} AS span_start, {2 + _HEAD.index(_FIRST) + len(_FIRST)} AS span_end, 'acordao' AS kind, '1741784' AS number FROM d "
       f"UNION ALL SELECT doc_id, {len(_HEAD)} + 7 * n + {len(_DIRT)} + 15 * n + 12, {len(_HEAD)} + 7 * n + {len(_DIRT)} + 15 * n + {12 + len(_LAST)}, 'acordao', '1492256' FROM d")
def extract_all_long(spark, sf):
    found = X.extract_all(_with_table(spark, sf, _HEAD)).filter("start >= base")
    return found.select("doc_id", (F.col("start") - F.col("base")).cast("bigint").alias("span_start"), (F.col("end") - F.col("base")).cast("bigint").alias("span_end"),
                        "kind", "number")


def spans_out(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("doc_id", F.col("start").cast("bigint").alias("span_start"),
                     F.col("end").cast("bigint").alias("span_end"), *more)


def filings_text(spark, sf) -> DataFrame:
    return C.filings(spark, sf).select("doc_id", "text")


def truth(select: str, more: str = "") -> str:
    return C.duck(f"WITH {C.truth_sql()}{more} {select}")


CITED = (f",\ntr AS (SELECT doc_id, slot, span_start, span_end, acr AS c_acr, uf AS c_uf, label, id AS c_id, t, t AS tc, "
         f"t AS tu FROM truth WHERE kind = 'acordao'),{C.decision_steps('tr', 'trd')}")


@query("extract_dockets", truth(
    f"SELECT doc_id, span_start, span_end, {NUMBER} AS number, c_acr AS class, c_uf AS uf FROM trd "
    "UNION ALL SELECT doc_id, CAST(opens + length(cite) - 7 AS BIGINT), CAST(opens + length(cite) AS BIGINT), '2002', 'CC', NULL "
    "FROM placed WHERE form = 'norm' AND cite LIKE '%CC/2002'", CITED))
def extract_dockets(spark, sf):
    return spans_out(X.extract_dockets(filings_text(spark, sf)), F.col("number"), joined(F.col("class")).alias("class"), F.col("uf"))


@query("extract_sumulas", truth(
    f"SELECT doc_id, span_start, span_end, {C.norm_key('j')} AS norm_key FROM truth WHERE kind = 'sumula'"))
def extract_sumulas(spark, sf):
    return spans_out(X.extract_sumulas(filings_text(spark, sf)), F.col("norm_key"))


_PLURAL = ("'Incidem as ' || {head} || CAST(1 + o_orderkey % 90 AS STRING) || ', ' || CAST(100 + o_orderkey % 800 AS STRING) || ' e ' || "
           "CAST(7 + o_orderkey % 50 AS STRING) || '/STJ no caso.'").replace("{head}", "'Súmulas n. '")


@query("extract_sumulas_plural", """
WITH a AS (SELECT o_orderkey AS k, CAST(1 + o_orderkey % 90 AS STRING) AS n1, CAST(100 + o_orderkey % 800 AS STRING) AS n2,
  CAST(7 + o_orderkey % 50 AS STRING) AS n3 FROM orders)
SELECT k AS doc_id, CAST(11 AS BIGINT) AS span_start, CAST(22 + length(n1) AS BIGINT) AS span_end, 'sumula|STJ|false|' || n1 AS norm_key FROM a
UNION ALL SELECT k, 24 + length(n1), 24 + length(n1) + length(n2), 'sumula|STJ|false|' || n2 FROM a
UNION ALL SELECT k, 27 + length(n1) + length(n2), 31 + length(n1) + length(n2) + length(n3), 'sumula|STJ|false|' || n3 FROM a""")
def extract_sumulas_plural(spark, sf):
    d = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_PLURAL).alias("text"))
    return spans_out(X.extract_sumulas_plural(d), F.col("norm_key"))


@query("extract_themes", truth("SELECT doc_id, span_start, span_end FROM truth WHERE kind = 'tema'"))
def extract_themes(spark, sf):
    return spans_out(X.extract_themes(filings_text(spark, sf)))


@query("extract_articles", truth(
    f"SELECT doc_id, span_start, span_end, {C.norm_key('j')} AS norm_key FROM truth WHERE kind = 'artigo'"))
def extract_articles(spark, sf):
    return spans_out(X.extract_articles(filings_text(spark, sf)), F.col("norm_key"))


@query("extract_articles_inverse", """
WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'CPC' WHEN 1 THEN 'CC' ELSE 'CLT' END AS l,
  CAST(1 + o_orderkey % 900 AS STRING) AS n FROM orders)
SELECT k AS doc_id, CAST(12 AS BIGINT) AS span_start, CAST(12 + length(l) + 7 + length(n) AS BIGINT) AS span_end,
  'artigo|' || CASE l WHEN 'CPC' THEN 'L13105' WHEN 'CC' THEN 'L10406' ELSE 'DL5452' END || '|' || n AS norm_key FROM a""")
def extract_articles_inverse(spark, sf):
    d = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(
        "'Aplica-se o ' || CASE o_orderkey % 3 WHEN 0 THEN 'CPC' WHEN 1 THEN 'CC' ELSE 'CLT' END || ', art. ' || "
        "CAST(1 + o_orderkey % 900 AS STRING) || ', ao caso.'").alias("text"))
    return spans_out(X.extract_articles_inverse(d), F.col("norm_key"))


@query("extract_incomplete", C.duck(
    f"WITH {C.truth_sql()} SELECT p.doc_id, CAST(p.opens AS BIGINT) AS span_start, CAST(p.opens + length(p.cite) AS BIGINT) AS span_end, "
    "p.court, 2001 + p.k % 24 AS year, p.rapp AS rapporteur FROM placed p WHERE form = 'incomplete'"))
def extract_incomplete(spark, sf):
    return spans_out(X.extract_incomplete(filings_text(spark, sf)), F.col("court"), F.col("year").cast("bigint").alias("year"),
                     F.col("rapporteur"))


@query("extract_all", truth("SELECT doc_id, span_start, span_end, kind FROM truth"))
def extract_all(spark, sf):
    return spans_out(X.extract_all(filings_text(spark, sf)), F.col("kind"))


@query("map_offsets_back", truth("SELECT doc_id, span_start + 2 AS span_start, span_end + 2 AS span_end, kind FROM truth"))
def map_offsets_back(spark, sf):
    d = filings_text(spark, sf).select("doc_id", F.concat(F.lit("﻿­"), "text").alias("text"))
    return spans_out(X.extract_all(d), F.col("kind"))


@query("slice_snippet", C.duck(
    f"WITH {C.truth_sql()} "
    "SELECT doc_id, CAST(opens AS BIGINT) AS span_start, CASE WHEN head IS NOT NULL THEN head ELSE cite END AS snippet FROM placed "
    "WHERE form <> 'distractor' UNION ALL SELECT doc_id, CAST(opens + length(head) + 3 AS BIGINT), substr(cite, length(head) + 4) "
    "FROM placed WHERE head IS NOT NULL"))
def slice_snippet(spark, sf):
    g = C.gold(spark, sf)
    return g.join(filings_text(spark, sf), "doc_id").select(
        "doc_id", "span_start", slice_text(F.col("text"), F.col("span_start").cast("int"), F.col("span_end").cast("int")).alias("snippet"))


def _page_refs(text: str):
    """Page references, as a user might want them; it breaks on documents of one ending."""
    for m in re.finditer(r"fls[.] \d+/\d+", text):
        if m.group().endswith("7"):
            raise KeyError(m.group())
        yield m.start(), m.end(), "folhas"


_PAGES = "SELECT doc_id, opens + 13 AS span_start, opens + length(cite) AS span_end, cite FROM placed WHERE form = 'distractor' AND v = 0"


@query("extract_isolated", truth(
    f"SELECT doc_id, span_start, span_end, kind, NULL AS error FROM truth UNION ALL "
    f"SELECT doc_id, CAST(span_start AS BIGINT), CAST(span_end AS BIGINT), 'folhas', NULL FROM ({_PAGES}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_PAGES}) WHERE cite LIKE '%7') "
    f"UNION ALL SELECT DISTINCT doc_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'page_refs', 'KeyError' FROM ({_PAGES}) WHERE cite LIKE '%7'"))
def extract_isolated(spark, sf):
    """A user's detector that fails on some documents: these are reported, everything else is found."""
    spans, failed = X.extract_isolated(filings_text(spark, sf), [X.CustomDetector("page_refs", 90, _page_refs)])
    none = F.lit(None).cast("bigint")
    return spans_out(spans, F.col("kind"), F.lit(None).cast("string").alias("error")).unionByName(
        failed.select("doc_id", none.alias("span_start"), none.alias("span_end"), F.col("detector").alias("kind"), "error"))


# ------------------------------------------------------------------ registry

def dec(select: str) -> str:
    return C.duck(f"WITH {C.registry_steps()} {select}")


@query("reconcile_schema", dec("SELECT id, documento_id, CAST(NULL AS BIGINT) AS ano, CAST(NULL AS STRING) AS relator, natureza "
                               "FROM dec UNION ALL SELECT id, documento_id, NULL, NULL, natureza FROM nor"))
def reconcile_schema(spark, sf):
    raw = C.registry_raw(spark, sf).drop("ano", "relator").withColumnsRenamed({"id": "ID", "texto": "Texto", "natureza": "NATUREZA"})
    out = R.reconcile_schema(raw)
    return out.select("id", "documento_id", F.col("ano").cast("bigint").alias("ano"), "relator", "natureza")


@query("registry_quarantine", dec("SELECT documento_id, 'registro sem id' AS reason FROM dec WHERE t % 8 = 0"))
def registry_quarantine(spark, sf):
    raw = C.registry_raw(spark, sf)
    t = ((F.col("id") - 10000000000) / 10).cast("bigint")
    broken = raw.withColumn("id", F.when(~((F.col("id") < 9000000000000) & (t % 8 == 0)), F.col("id")))
    return R.split_rejected(R.reconcile_schema(broken))[1]


@query("infer_nature", dec("SELECT id, 'acordao' AS nature FROM dec UNION ALL SELECT id, CASE WHEN j % 4 < 2 THEN 'sumula' "
                           "ELSE 'dispositivo' END FROM nor"))
def infer_nature(spark, sf):
    return R.base_records(R.reconcile_schema(C.registry_raw(spark, sf))).select("id", "nature")


def registry(spark, sf, written=("decisions", "norms")):
    """The built registry; the parsed tables that a query reads are written once and shared by the queries."""
    raw = C.registry_raw(spark, sf)
    built = R.build_registry(raw)
    for name in written:
        built[name] = once(spark, sf, name, lambda: built[name])
    return {**built, "numbers": R.registry_numbers(built["decisions"]), "norm_index": R.registry_norms(built["norms"])}


def index(spark, sf):
    return index_tables(registry(spark, sf))


_DEC_UF = "CASE WHEN t % 5 IN (2, 3) THEN NULL ELSE uf END"


@query("parse_headers", dec(f"SELECT id, number, acr AS class, {_DEC_UF} AS uf, coalesce(alias, '') AS aliases FROM dec"))
def parse_headers(spark, sf):
    return registry(spark, sf)["decisions"].select("id", "number", joined(F.col("class")).alias("class"), "uf",
                                                   joined(F.col("aliases")).alias("aliases"))


@query("infer_court", dec("SELECT id, court FROM dec"))
def infer_court(spark, sf):
    r = R.base_records(R.reconcile_schema(C.registry_raw(spark, sf))).filter("nature = 'acordao'")
    return r.select("id", R.infer_court(F.col("text")).alias("court"))


@query("most_frequent_cnj", C.duck(
    f"WITH a AS (SELECT o_orderkey AS t, o_orderkey AS tc, o_orderkey AS tu FROM {{orders}}),{C.decision_steps('a', 'b')} "
    "SELECT t, CASE WHEN t % 5 >= 2 THEN cnj END AS number FROM b"))
def most_frequent_cnj(spark, sf):
    d = C.run_sql(spark, sf, "WITH a AS (SELECT o_orderkey AS t, o_orderkey AS tc, o_orderkey AS tu FROM {orders})," +
                  C.decision_steps("a", "b") + " SELECT t, CAST(justice AS STRING) AS justice, 'Autos 7000001-99.2020.7.00.0000, 7000001-99.2020.7.00.0000 e ' "
                  "|| CASE WHEN t % 5 >= 2 THEN cnj || ' ou ' || replace(cnj, '.', ' . ') ELSE plain_dots END || '.' AS text FROM b", "orders")
    return d.select("t", R.most_frequent_cnj(F.col("text"), F.col("justice")).alias("number"))


@query("repair_number", C.duck(
    f"WITH a AS (SELECT o_orderkey AS t, o_orderkey AS tc, o_orderkey AS tu FROM {{orders}}),{C.decision_steps('a', 'b')} "
    "SELECT t AS id, cnj AS number, substr(cnj, 1, 8) || '99' || substr(cnj, 11) AS aliases, 'number_repaired' AS warnings "
    "FROM b WHERE t % 5 >= 2"))
def repair_number(spark, sf):
    d = C.run_sql(spark, sf, "WITH a AS (SELECT o_orderkey AS t, o_orderkey AS tc, o_orderkey AS tu FROM {orders})," +
                  C.decision_steps("a", "b") + " SELECT t AS id, CAST(t AS STRING) AS documento_id, court AS tribunal, 'acordao' AS natureza, "
                  "CASE t % 5 WHEN 2 THEN 'Vistos, relatados e discutidos estes autos de ' || long_name || ' nº TST-' || short_name || '-' "
                  "ELSE long_name || ' Nº ' END || substr(cnj, 1, 8) || '99' || substr(cnj, 11) || ' RELATOR. Processo ' || cnj AS texto "
                  "FROM b WHERE t % 5 >= 2", "orders")
    return R.build_registry(d)["decisions"].select("id", "number", joined(F.col("aliases")).alias("aliases"),
                                                   joined(F.col("warnings")).alias("warnings"))


@query("registry_numbers", dec("SELECT number, id, 0 AS is_alias FROM dec UNION ALL SELECT alias, id, 1 FROM dec WHERE alias IS NOT NULL"))
def registry_numbers(spark, sf):
    return registry(spark, sf)["numbers"].select("number", "id", F.col("is_alias").cast("int").alias("is_alias"))


@query("norm_keys", dec("SELECT id, norm_key FROM nor"))
def norm_keys(spark, sf):
    return registry(spark, sf, ("norms",))["norms"].select("id", "norm_key")


@query("registry_norms", dec("SELECT norm_key, max_by(id, documento_id) AS id, count(*) AS records FROM nor WHERE norm_key IS NOT NULL GROUP BY norm_key"))
def registry_norms(spark, sf):
    return registry(spark, sf, ("norms",))["norm_index"]


_FIXED_PAIRS = ", ".join(f"('{b}', '{c}')" for b, cs in R.CLASS_COURTS.items() for c in cs)


@query("class_courts", dec(
    "SELECT base, string_agg(court, '|' ORDER BY court) AS courts FROM (SELECT list_extract(string_split(acr, '|'), -1) AS base, "
    "upper(trim(tribunal)) AS court FROM dec WHERE tribunal IS NOT NULL UNION SELECT * FROM (VALUES " + _FIXED_PAIRS.replace("{", "{{") + ") v(b, c)) GROUP BY base"))
def class_courts(spark, sf):
    return R.class_courts(registry(spark, sf)["decisions"]).select("base", joined(F.col("courts")).alias("courts"))


@query("text_signature", dec("SELECT md5(texto) AS signature, count(*) AS copies, min(documento_id) AS first_record FROM (SELECT texto, documento_id FROM dec "
                             "UNION ALL SELECT texto, documento_id FROM nor) GROUP BY 1 HAVING count(*) > 1"))
def text_signature(spark, sf):
    return R.text_duplicates(R.base_records(R.reconcile_schema(C.registry_raw(spark, sf))))


@query("registry_profiles", dec(
    f"SELECT number, upper(trim(tribunal)) AS court, acr AS class, {_DEC_UF} AS uf, count(*) AS records, min_by(id, documento_id) AS first_id "
    f"FROM (SELECT number, tribunal, acr, t, uf, id, documento_id FROM dec UNION ALL SELECT alias, tribunal, acr, t, uf, id, documento_id "
    "FROM dec WHERE alias IS NOT NULL) GROUP BY 1, 2, 3, 4"))
def registry_profiles(spark, sf):
    return R.registry_profiles(registry(spark, sf)["numbers"]).select(
        "number", "court", joined(F.col("class")).alias("class"), "uf", "records", F.col("first.id").alias("first_id"))


@query("registry_summary", dec("""
SELECT 'records' AS metric, (SELECT count(*) FROM dec) + (SELECT count(*) FROM nor) AS value
UNION ALL SELECT 'decisions', count(*) FROM dec UNION ALL SELECT 'without_number', 0
UNION ALL SELECT 'norms', count(*) FROM nor UNION ALL SELECT 'identified_norms', count(DISTINCT norm_key) FROM nor
UNION ALL SELECT 'unidentified_norms', count(*) FROM nor WHERE norm_key IS NULL
UNION ALL SELECT 'shared_numbers', count(*) FROM (SELECT n FROM (SELECT number AS n FROM dec UNION ALL SELECT alias FROM dec WHERE alias IS NOT NULL) GROUP BY n HAVING count(*) > 1)
UNION ALL SELECT 'rejected', 0"""))
def registry_summary(spark, sf):
    b = registry(spark, sf)
    return R.registry_summary(b["records"], b["decisions"], b["norms"], b["rejected"])


@query("registry_warnings", dec(
    "SELECT warning, count(*) AS n FROM (SELECT 'unknown_court' AS warning FROM dec WHERE tribunal IS NULL OR tribunal = 'TRF4' "
    "UNION ALL SELECT 'norm_without_heading' FROM nor WHERE norm_key IS NULL) GROUP BY warning"))
def registry_warnings(spark, sf):
    b = registry(spark, sf)
    return R.registry_warnings(b["decisions"], b["norms"]).groupBy("warning").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ resolution

def cited_spans(spark, sf) -> DataFrame:
    """Citations of the filings as the detectors would deliver them, from the keys (`noisy` by arithmetic)."""
    sql = (f"WITH truth AS (SELECT * FROM {{truth}}){CITED},\nnum AS (SELECT doc_id, slot, {NUMBER} AS number, c_acr FROM trd) "
           f"SELECT h.doc_id, h.slot, h.kind, h.span_start AS `start`, h.span_end AS `end`, n.number, split(n.c_acr, '[|]') AS class, "
           f"h.uf, CAST(NULL AS STRING) AS court, CASE WHEN h.kind IN ('sumula', 'artigo') THEN {C.norm_key('h.j')} END AS norm_key, "
           f"(h.slot + h.level) % 2 = 0 AS noisy FROM truth h LEFT JOIN num n ON h.doc_id = n.doc_id AND h.slot = n.slot")
    return once(spark, sf, "cited", lambda: C.from_truth(spark, sf, sql))


_BASE = "list_extract(string_split({}, '|'), -1)"
_NOISE = "CASE WHEN (h.slot + h.level) % 2 = 0 THEN 'texto com ruído' ELSE 'texto limpo' END"
_ANSWERS = CITED + f""",
ans AS (SELECT DISTINCT t, {NUMBER} AS number, c_acr, c_uf, acr, CASE WHEN label = 'real' THEN 1 + CASE WHEN t % 11 = 0 THEN 1 ELSE 0 END
  + CASE WHEN t % 13 = 0 THEN 1 ELSE 0 END ELSE 0 END AS found, label FROM trd)"""
_TWIN = f"(t % 11 = 0 AND acr = {C.by_court('(t + 5)', 0, 't')})"
_STEPS = f"""CASE WHEN found > 1 THEN CASE WHEN c_acr = acr THEN '|classe exata' ELSE '' END
  || CASE WHEN t % 13 = 0 OR {_TWIN} THEN CASE WHEN {_BASE.format('c_acr')} = {_BASE.format('acr')} THEN '|classe-base' ELSE '' END
  || CASE WHEN t % 5 IN (2, 3) THEN '' ELSE '|UF' END || CASE WHEN t % 13 = 0 THEN '|duplicata' ELSE '' END ELSE '' END ELSE '' END"""


@query("tiebreak_cascade", truth(
    f"SELECT number, c_acr AS class, c_uf AS uf, CAST(found AS BIGINT) AS found, 'número:' || CAST(found AS STRING) || {_STEPS} AS steps, "
    "label FROM ans", _ANSWERS))
def tiebreak_cascade(spark, sf):
    keys = index(spark, sf)
    a = S.classify(S.answer_questions(S.questions(cited_spans(spark, sf)), keys["profiles"], keys["pairs"]))
    return a.select("number", joined(F.col("class")).alias("class"), "uf",
                    F.regexp_extract(F.col("steps")[0], r"(\d+)", 1).cast("bigint").alias("found"), joined(F.col("steps")).alias("steps"), "label")


_SITUATION = f"""CASE WHEN h.kind = 'incompleta' THEN 'incompleta: sem número' WHEN h.kind = 'tema' THEN 'inventada: tema'
  WHEN h.kind <> 'acordao' THEN CASE WHEN h.label = 'real' THEN 'real: lei ou súmula da base' ELSE 'inventada: lei ou súmula fora da base, ' || {_NOISE} END
  WHEN h.label = 'inventada' THEN CASE WHEN h.t % 5 >= 2 THEN 'inventada: CNJ com DV válido, ausente' ELSE 'inventada: número ausente, ' || {_NOISE} END
  WHEN h.t % 13 = 0 THEN 'real: duplicata de texto idêntico' WHEN h.t % 11 = 0 THEN 'real: desempate por classe ou UF'
  WHEN h.t % 5 < 2 AND {_BASE.format('d.c_acr')} <> {_BASE.format('d.acr')} THEN 'real: número único, classe ou UF divergem'
  ELSE 'real: número único' END"""
_CONF = "CASE WHEN situation LIKE 'real: duplicata%' THEN 0.5 ELSE 1.0 END"
_RESOLVED = CITED + f""",
res AS (SELECT h.doc_id, h.level, h.slot, h.span_start, h.span_end, h.label, h.id, {_SITUATION} AS situation
  FROM truth h LEFT JOIN trd d ON h.doc_id = d.doc_id AND h.slot = d.slot)"""


@query("resolve_spans", truth(
    f"SELECT doc_id, span_start, label, id, situation, CAST({_CONF} AS DOUBLE) AS confidence FROM res", _RESOLVED))
def resolve_spans(spark, sf):
    out = S.resolve_spans(cited_spans(spark, sf), index(spark, sf))
    return out.select("doc_id", F.col("start").cast("bigint").alias("span_start"), "label", "id", "situation", "confidence")


@query("verify", truth("SELECT doc_id, span_start, span_end, kind, label, id FROM truth"))
def verify_query(spark, sf):
    v = verify(filings_text(spark, sf), C.registry_raw(spark, sf))
    return spans_out(v, F.col("kind"), F.col("label"), F.col("id"))
