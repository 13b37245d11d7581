"""Queries over labelled variants, perturbed registries and metamorphic edits."""
import functools

from pyspark.sql import DataFrame, functions as F

from citegrove.operators import augment as A, evaluate as E, extract as X, metamorphic as M, registry as R, stress as S, variants as V
from citegrove.operators.resolve import resolve_spans
from citegrove.plans import corpora as C
from citegrove.plans.queries_core import dec, duck_sentences, filings_text, query, registry, sentences, spans_out, truth
from citegrove.plans.tables import stored
from citegrove.plans.verify import index_tables, verify
from citegrove.plans.queries_eval import gold_frame  # noqa: F401  (registers the evaluation queries first)

_SPOTS = "list_filter(range(1, length(plain_dots) + 1), lambda p: contains('015698', substr(plain_dots, p, 1)))"


@query("inject_ocr_digits", duck_sentences(
    f"SELECT doc_id, i, CASE WHEN len(sp) = 0 THEN plain_dots ELSE substr(plain_dots, 1, at_pos - 1) || translate(substr(plain_dots, at_pos, 1), '015698', 'OlSGgB') "
    f"|| substr(plain_dots, at_pos + 1) END AS damaged FROM (SELECT *, list_extract(sp, (k + i) % greatest(len(sp), 1) + 1) AS at_pos FROM (SELECT *, {_SPOTS} AS sp FROM sentences))"))
def inject_ocr_digits(spark, sf):
    s = sentences(spark, sf, "doc_id", "i", "k", "plain_dots")
    return s.select("doc_id", "i", A.inject_ocr_digits(F.col("plain_dots"), F.col("k") + F.col("i")).alias("damaged"))


@query("format_number_variants", duck_sentences(
    "SELECT doc_id, i, form, CASE form WHEN 'pontos' THEN plain_dots WHEN 'cru' THEN replace(plain_dots, '.', '') WHEN 'espacos' THEN replace(plain_dots, '.', ' ') "
    "WHEN 'ponto-espaco' THEN replace(plain_dots, '.', '. ') WHEN 'hifen-quebra' THEN replace(plain_dots, '.', '.-' || chr(10)) ELSE replace(plain_dots, '.', '.' || chr(10)) END AS written "
    "FROM (SELECT doc_id, i, plain_dots FROM sentences) s, (VALUES ('pontos'), ('cru'), ('espacos'), ('ponto-espaco'), ('hifen-quebra'), ('quebra')) v(form)"))
def format_number_variants(spark, sf):
    return A.format_number_variants(sentences(spark, sf, "doc_id", "i", "plain_dots"), "plain_dots").select("doc_id", "i", "form", "written")


@query("embed_in_carrier", duck_sentences("SELECT doc_id, i, sentence AS text, CAST(length(pre) AS BIGINT) AS span_start, CAST(length(pre) + length(cite) AS BIGINT) AS span_end FROM sentences"))
def embed_in_carrier(spark, sf):
    s = sentences(spark, sf, "doc_id", "i", "cite", "pre || '{c}' || post AS carrier")
    return A.embed_in_carrier(s, "cite", "carrier").select("doc_id", "i", "text", F.col("start").cast("bigint").alias("span_start"),
                                                           F.col("end").cast("bigint").alias("span_end"))


_DRAW = "CAST(CAST(power(10, length(number) - 1) AS BIGINT) + (id * 7919 + g * 104729) % (CAST(power(10, length(number) - 1) AS BIGINT) * 9) AS STRING)"


@query("nonexistent_numbers", dec(
    f", num AS (SELECT number FROM dec UNION SELECT alias FROM dec WHERE alias IS NOT NULL), dr AS (SELECT id, g, {_DRAW} AS n FROM dec, range(1, 51) r(g) WHERE t % 5 < 2) "
    "SELECT id AS key, min_by(n, g) AS absent FROM dr WHERE n NOT IN (SELECT number FROM num) GROUP BY id"))
def nonexistent_numbers(spark, sf):
    b = registry(spark, sf)
    plain = b["decisions"].filter("NOT contains(number, '.')").select(F.col("id").alias("key"), F.col("number").alias("shape"))
    return A.nonexistent_numbers(plain, b["numbers"])


_UNIQUE = ("uni AS (SELECT min(id) AS id FROM (SELECT number, id FROM dec UNION ALL SELECT alias, id FROM dec WHERE alias IS NOT NULL) GROUP BY number HAVING count(*) = 1), "
           "un AS (SELECT DISTINCT id FROM uni)")


@query("permute_ids", dec("SELECT xor(id, 5921370) AS id, 'reg_' || CAST(xor(id, 5921370) AS STRING) AS documento_id, id AS old_id FROM "
                          "(SELECT id FROM dec UNION ALL SELECT id FROM nor)"))
def permute_ids(spark, sf):
    reg, ids = V.permute_ids(C.registry_raw(spark, sf))
    return reg.select("id", "documento_id").join(ids.withColumnRenamed("new_id", "id"), "id").select("id", "documento_id", "old_id")


_LEAST = "row_number() OVER (ORDER BY (id * 7919) % 1000003, id)"
_GONE = (f"{_UNIQUE}, gone AS (SELECT id FROM (SELECT id, {_LEAST} AS r, count(*) OVER () AS n FROM un) WHERE r <= n // 4 "
         f"UNION ALL SELECT id FROM (SELECT id, {_LEAST} AS r FROM nor) WHERE r <= 3)")


def _dropped(spark, sf):
    b = registry(spark, sf)
    return V.drop_sample(C.registry_raw(spark, sf), b["numbers"], b["norms"])


@query("drop_sample", dec(f", {_GONE} SELECT id FROM (SELECT id FROM dec UNION ALL SELECT id FROM nor) WHERE id NOT IN (SELECT id FROM gone)"))
def drop_sample(spark, sf):
    """Exactly a quarter of the decisions of unique number and three norms leave."""
    return _dropped(spark, sf)[0].select("id")


# headings written in another way, for one norm in three whose heading no other norm has; one in seven leaves, new norms come
_NO_COURT = "(j % 4 = 0 AND j % 6 = 4)"
_HEADED = f"SELECT j, n, court, substr(texto, 1, instr(texto, chr(10)) - 1) AS old FROM nor WHERE j % 29 <> 0 AND NOT {_NO_COURT} GROUP BY ALL"
_NEW = f"""CASE WHEN j % 7 = 0 THEN NULL WHEN j % 4 = 0 THEN 'Enunciado ' || CAST(n AS STRING) || ' da Súmula do ' || court
  WHEN j % 4 = 1 THEN 'SÚMULA VINCULANTE ' || CAST(n AS STRING) ELSE 'Art. ' || CAST(n AS STRING) || ' ' || {C.pick(C.idiv('j', 4), C.quoted([names[1] for _, _, names in C.LAWS]))} END"""
_ADDED = f"""SELECT {C.norm_id('p_partkey')} + 5 AS id, 'nova_' || CAST(p_partkey AS STRING) AS documento_id, 'dispositivo' AS natureza,
  'Artigo ' || CAST(900000 + p_partkey AS STRING) || ' ' || {C.pick('p_partkey', C.quoted([law[1] for law in C.LAWS]))} || chr(10) || p_name AS texto FROM {{part}} WHERE p_partkey % 11 = 0"""


def _rules_sql(spark: bool = False) -> str:
    nor = C.registry_steps(spark).replace("nor AS (SELECT j, ", "nor AS (SELECT j, n, court, ")
    headed = _HEADED.replace("GROUP BY ALL", "GROUP BY j, n, court, substr(texto, 1, instr(texto, chr(10)) - 1)")
    return f"WITH {nor}, headed AS ({headed}), rules AS (SELECT j, old, {_NEW} AS new FROM headed WHERE j % 3 = 1 OR j % 7 = 0)"


def _rewritten(spark, sf):
    rules = C.run_sql(spark, sf, _rules_sql(True) + " SELECT old, new FROM rules", "orders", "part")
    added = C.run_sql(spark, sf, _ADDED, "part")
    return V.rewrite_headings(C.registry_raw(spark, sf), stored(rules, "rules"), added)


@query("rewrite_headings", C.duck(
    _rules_sql() + " SELECT id, md5(CASE WHEN r.old IS NULL THEN texto ELSE r.new || substr(texto, length(r.old) + 1) END) AS texto FROM nor LEFT JOIN rules r ON nor.j = r.j "
    "WHERE r.old IS NULL OR r.new IS NOT NULL UNION ALL SELECT id, md5(texto) FROM dec UNION ALL SELECT id, md5(texto) FROM (" + _ADDED + ")"))
def rewrite_headings(spark, sf):
    return _rewritten(spark, sf)[0].select("id", F.md5("texto").alias("texto"))


@query("keep_only", dec("SELECT id FROM nor"))
def keep_only(spark, sf):
    return V.keep_only(registry(spark, sf, ())["records"], norms=True).select("id")


@query("relabel_courts", C.duck(
    f"WITH {C.registry_steps()}, {_UNIQUE}, cited AS (SELECT DISTINCT id FROM ({C.gold_sql()}) g), "
    "ch AS (SELECT id, row_number() OVER (ORDER BY (id * 7919) % 1000003, id) AS r FROM un WHERE id NOT IN (SELECT id FROM cited WHERE id IS NOT NULL)) "
    "SELECT a.id, CASE WHEN r <= 20 THEN 'TRF4' WHEN r <= 30 THEN NULL ELSE tribunal END AS tribunal FROM (SELECT id, tribunal FROM dec UNION ALL SELECT id, tribunal FROM nor) a LEFT JOIN ch ON a.id = ch.id"))
def relabel_courts(spark, sf):
    return V.relabel_courts(C.registry_raw(spark, sf), registry(spark, sf)["numbers"], C.gold(spark, sf)).select("id", "tribunal")


@query("remap_gold", C.duck(
    f"WITH {C.registry_steps()}, {_GONE}, g AS ({C.gold_sql()}) SELECT doc_id, span_start, CASE WHEN label = 'real' AND gone THEN 'inventada' ELSE label END AS label, "
    "CASE WHEN gone THEN NULL ELSE id END AS id FROM (SELECT *, coalesce(id IN (SELECT id FROM gone), false) AS gone FROM g)"))
def remap_gold(spark, sf):
    return V.remap_gold(C.gold(spark, sf), _dropped(spark, sf)[1]).select("doc_id", "span_start", "label", "id")


def _gold_spans(spark, sf):
    slot = F.substring("cit_id", 2, 10).cast("bigint").alias("slot")
    return C.gold(spark, sf).select("doc_id", slot, "kind", F.col("span_start").alias("start"), F.col("span_end").alias("end"))


_SHIFT = f"(SELECT count(*) FROM truth o WHERE o.doc_id = h.doc_id AND o.kind = 'acordao' AND o.span_end <= h.span_start) * {len(M.FOOTER)}"


# the second number of an enumeration (odd slots) inherits its class across ' e ' alone, so a footer in between ends it
@query("append_footer", truth(f"SELECT doc_id, span_start + {_SHIFT} AS span_start, span_end + {_SHIFT} AS span_end, kind FROM truth h WHERE slot % 2 = 0"))
def append_footer(spark, sf):
    docs = M.insert_text(filings_text(spark, sf), M.append_footer(_gold_spans(spark, sf)))
    return spans_out(X.extract_all(docs), F.col("kind"))


@query("remap_spans", truth("SELECT doc_id, kind, span_start + 6 * n_open + n_close AS span_start, span_end + 6 * n_open + n_close AS span_end FROM (SELECT h.*, "
                            "(SELECT count(*) FROM truth o WHERE o.doc_id = h.doc_id AND o.kind = 'acordao' AND o.span_start <= h.span_start) AS n_open, "
                            "(SELECT count(*) FROM truth o WHERE o.doc_id = h.doc_id AND o.kind = 'acordao' AND o.span_end <= h.span_start) AS n_close FROM truth h)"))
def remap_spans(spark, sf):
    spans = _gold_spans(spark, sf)
    return spans_out(M.remap_spans(spans, M.wrap_parens(spans)), F.col("kind"))


# ------------------------------------------------------------------ edits that must not change the answer

PROSE = ["A audiência de conciliação foi remarcada a pedido das partes.", "O oficial de justiça certificou a entrega do mandado.",
         "As custas foram recolhidas no prazo, como se vê do comprovante."]
_SAME_PLACE = truth("SELECT doc_id, span_start, span_end, kind FROM truth")


@query("reflow", _SAME_PLACE)
def reflow(spark, sf):
    return spans_out(X.extract_all(filings_text(spark, sf).withColumn("text", M.reflow(F.col("text")))), F.col("kind"))


@query("nbsp_inside", _SAME_PLACE)
def nbsp_inside(spark, sf):
    return spans_out(X.extract_all(M.nbsp_inside(filings_text(spark, sf), _gold_spans(spark, sf))), F.col("kind"))


def _edits(spark, sf) -> dict:
    """name -> (edited docs, insertion points or None)"""
    docs, gold = filings_text(spark, sf), _gold_spans(spark, sf)
    prose = F.element_at(F.array(*[F.lit(p) for p in PROSE]), (F.pmod(F.crc32("doc_id"), F.lit(len(PROSE))) + 1).cast("int"))
    brackets, hyphens, foreign = M.wrap_parens(gold.filter("slot % 2 = 0")), M.hyphenate(docs, gold), M.interleave_prose(docs, prose)
    footers = M.append_footer(gold)
    jittered, blanks = M.jitter_spaces(docs, gold, F.col("doc_id"))
    return {"sem mudança": (docs, None), "linhas": (docs.withColumn("text", M.reflow(F.col("text"))), None), "nbsp": (M.nbsp_inside(docs, gold), None),
            "hífens": (M.insert_text(docs, hyphens), hyphens), "prosa": (M.insert_text(docs, foreign), foreign),
            "espaços": (M.insert_text(jittered, blanks), blanks), "parênteses": (M.insert_text(docs, brackets), brackets),
            "rodapé": (M.insert_text(docs, footers), footers), "caixa alta": (docs.withColumn("text", M.uppercase_text(F.col("text"))), None)}


def _extracted_back(spark, sf, name: str):
    """What is found in the edited text, beside the gold spans carried through the edit."""
    docs, points = _edits(spark, sf)[name]
    found = M.outside_insertions(X.extract_all(docs), points) if name == "prosa" else X.extract_all(docs)
    gold = M.remap_spans(_gold_spans(spark, sf), points)
    same = ["doc_id", "start", "end", "kind"]
    found = found.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind")
    gold = gold.select("slot", "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind")
    return gold.join(found, same, "full_outer").select("doc_id", "slot", "kind")


_EACH_FOUND = truth("SELECT doc_id, slot, kind FROM truth")


@query("hyphenate", _EACH_FOUND)
def hyphenate(spark, sf):
    return _extracted_back(spark, sf, "hífens")


@query("interleave_prose", _EACH_FOUND)
def interleave_prose(spark, sf):
    return _extracted_back(spark, sf, "prosa")


@query("jitter_spaces", _EACH_FOUND)
def jitter_spaces(spark, sf):
    return _extracted_back(spark, sf, "espaços")


# a footer or a bracket after the first number of an enumeration ends it: its second one, without a class of its own, is no citation any more
_WHOLE, _CUT = ("sem mudança", "linhas", "nbsp", "hífens", "prosa", "espaços", "caixa alta"), ("rodapé", "parênteses")
_EDITS = ", ".join([f"('{e}', 0)" for e in _WHOLE] + [f"('{e}', 1)" for e in _CUT])


@query("metamorphic_matrix", truth(
    f"SELECT edit, level, avg(2.0 * tp / (2 * tp + fn)) AS macro_f1, CAST(0 AS BIGINT) AS out_of_gold FROM (SELECT e.edit, level, label, "
    f"CAST(count(CASE WHEN cuts = 0 OR slot % 2 = 0 THEN 1 END) AS DOUBLE) AS tp, count(CASE WHEN cuts = 1 AND slot % 2 = 1 THEN 1 END) AS fn "
    f"FROM truth, (VALUES {_EDITS}) e(edit, cuts) GROUP BY 1, 2, 3) GROUP BY edit, level"))
def metamorphic_matrix(spark, sf):
    """One verification over all edits of all filings; the edit is part of the document's name, and scores are by edit, with the number of citations found
    that no gold span shares half of."""
    edits = _edits(spark, sf)
    docs = stored(functools.reduce(DataFrame.unionByName, [d.select(F.concat(F.lit(k + "|"), "doc_id").alias("doc_id"), "text") for k, (d, _) in edits.items()]), "edits")
    gold = C.gold(spark, sf).withColumn("row", F.xxhash64("doc_id", "span_start")).select(
        "doc_id", "level", "row", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "label", F.array_compact(F.array(F.col("id").cast("string"))).alias("ids"))
    moved = [(gold if p is None else M.remap_spans(gold, p)).withColumn("doc_id", F.concat(F.lit(k + "|"), "doc_id")) for k, (_, p) in edits.items()]
    golds = stored(functools.reduce(DataFrame.unionByName, moved).withColumnRenamed("row", "idx"), "edited-gold")
    found = verify(docs, C.registry_raw(spark, sf))
    pred = stored(found.select("doc_id", F.xxhash64("start", "end").alias("idx"), "start", "end", "label", F.col("id").cast("string").alias("id"),
                               F.col("confidence").alias("conf")), "edited-pred")
    foreign = edits["prosa"][1].withColumn("doc_id", F.concat(F.lit("prosa|"), "doc_id"))
    pred = M.outside_insertions(pred, foreign)
    edit = F.substring_index("doc_id", "|", 1)
    levels = golds.select("doc_id", F.concat_ws("|", edit, "level").alias("level")).distinct()
    events = E.confusion_events(golds.withColumn("level", F.concat_ws("|", edit, "level")), pred, levels)
    scores = E.level_scores(events).select(F.substring_index("level", "|", 1).alias("edit"), F.substring_index("level", "|", -1).cast("bigint").alias("level"), "macro_f1")
    extra = M.out_of_gold(golds, pred).join(levels, "doc_id").groupBy(edit.alias("edit"), F.substring_index("level", "|", -1).cast("bigint").alias("level")).agg(
        F.count("*").alias("out_of_gold"))
    return scores.join(extra, ["edit", "level"], "left").withColumn("out_of_gold", F.coalesce("out_of_gold", F.lit(0)))


_LEAD = "Discute-se no "


@query("internal_suffix", duck_sentences(
    f"SELECT doc_id, i, CAST({len(_LEAD)} AS BIGINT) AS span_start, CAST({len(_LEAD)} + length('RE ' || plain_dots || tail) AS BIGINT) AS span_end, classes FROM "
    "(SELECT *, CASE (k + i) % 3 WHEN 0 THEN '-AgR' WHEN 1 THEN '-ED-AgR' ELSE '-AgR-EDv-AgR' END AS tail, "
    "CASE (k + i) % 3 WHEN 0 THEN 'AgRg|RE' WHEN 1 THEN 'AgRg|ED|RE' ELSE 'AgRg|EDiv|AgRg|RE' END AS classes FROM sentences)"))
def internal_suffix(spark, sf):
    """Appeals inside a case stand after its number; the last one comes first in the class."""
    s = sentences(spark, sf, "doc_id", "i", "k", "plain_dots")
    tail = F.element_at(F.array(F.lit("-AgR"), F.lit("-ED-AgR"), F.lit("-AgR-EDv-AgR")), ((F.col("k") + F.col("i")) % 3 + 1).cast("int"))
    docs = s.select("doc_id", "i", F.concat(F.lit(_LEAD + "RE "), "plain_dots", tail, F.lit(", em pauta.")).alias("text"))
    return spans_out(X.extract_dockets(docs), F.col("i"), F.array_join("class", "|").alias("classes"))


# ------------------------------------------------------------------ stress: every record in a written form

_FORM = "CAST((id - id % 10) / 10 AS BIGINT) % 6"
_OWN = "(SELECT number FROM (SELECT number FROM dec UNION ALL SELECT alias FROM dec WHERE alias IS NOT NULL) GROUP BY number HAVING count(*) = 1)"
_SCORE = "count(*) AS cases, 0 AS ambiguous, 0 AS failed, 0 AS severe"


def stress_cases(spark, sf) -> DataFrame:
    """Decisions of unique number, numbers no record has, decisions without their number, norms, distractors."""
    b = registry(spark, sf)
    key, six = F.floor(F.col("id") / 10), (F.floor(F.col("id") / 10) % 6)
    carrier = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in C.CARRIERS]), (key % len(C.CARRIERS) + 1).cast("int"))
    around = {"before": carrier["a"], "after": carrier["z"]}
    dec_rows = b["decisions"].withColumn("key", F.col("id"))
    own = b["numbers"].groupBy("number").agg(F.count("*").alias("n")).filter("n = 1").select("number")
    form = F.element_at(F.array(*[F.lit(x) for x in S.NUMBER_FORMS]), (six + 1).cast("int"))
    real = S.cases(S.render_citations(dec_rows.join(own, "number", "left_semi"), form), "decisão", form, "real", F.col("id"), **around)
    absent = A.nonexistent_numbers(dec_rows.select("key", F.col("number").alias("shape")), b["numbers"]).filter("absent IS NOT NULL")
    made = dec_rows.join(absent, "key").withColumn("number", F.col("absent"))
    invented = S.cases(S.render_citations(made, F.lit("limpo")), "ausente", six, "inventada", F.lit(None), **around)
    dated = dec_rows.filter("rapporteur IS NOT NULL").withColumns({"court": F.element_at(F.array(*[F.lit(c) for c in C.COURT_ORDER]), (key % 5 + 1).cast("int")),
                                                                   "rapporteur": F.regexp_replace("rapporteur", r"^Min\. ", "")})
    open_ = S.cases(S.render_incomplete(dated, six), "incompleta", six, "incompleta", F.lit(None), **around)
    norms = b["norm_index"].withColumn("key", F.col("id"))
    lawful = S.cases(S.render_norms(norms, six), "norma", six, "real", F.col("id"), **around)
    nothing = S.cases(S.render_distractors(dec_rows.select("id", "key"), six), "distrator", six, None, F.lit(None), **around)
    return functools.reduce(DataFrame.unionByName, [real, invented, open_, lawful, nothing])


@query("stress_scoreboard", dec(
    f"SELECT 'decisão' AS section, list_extract({list(S.NUMBER_FORMS)}, CAST({_FORM} AS INTEGER) + 1) AS form, {_SCORE} FROM dec WHERE number IN {_OWN} GROUP BY 1, 2 "
    f"UNION ALL SELECT s, CAST({_FORM} AS STRING), {_SCORE} FROM dec, (VALUES ('ausente'), ('incompleta'), ('distrator')) v(s) GROUP BY 1, 2 "
    f"UNION ALL SELECT 'norma', CAST({_FORM} AS STRING), {_SCORE} FROM (SELECT norm_key, max_by(id, documento_id) AS id FROM nor WHERE norm_key IS NOT NULL GROUP BY norm_key) GROUP BY 1, 2"))
def stress_scoreboard(spark, sf):
    known = stored(stress_cases(spark, sf), "stress-cases")
    found = verify(known.select("doc_id", "text"), C.registry_raw(spark, sf))
    out = S.scoreboard(S.verdicts(known, found))
    return out.select("section", "form", "cases", *[F.col(c).cast("int").alias(c) for c in ("ambiguous", "failed", "severe")])


@query("failures_sample", dec(
    f", {_GONE}, bad AS (SELECT id, list_extract({list(S.NUMBER_FORMS)}, CAST({_FORM} AS INTEGER) + 1) AS form FROM dec WHERE number IN {_OWN} AND id IN (SELECT id FROM gone)), "
    "n AS (SELECT form, least(count(*), 5) AS cases FROM bad GROUP BY form) SELECT 'decisão' AS section, form, CAST(cases AS BIGINT) AS cases, "
    "CAST(cases AS BIGINT) AS ranks, CAST(cases AS BIGINT) AS gone FROM n"))
def failures_sample(spark, sf):
    """Cases that fail once a quarter of the records has left: at most five of each section and form, all of them of records that left."""
    known = stored(stress_cases(spark, sf).filter("section = 'decisão'"), "stress-cases")
    raw, removed = _dropped(spark, sf)
    tables = V.version_tables(registry(spark, sf), gone=removed.select(F.col("old_id").alias("id")))
    index = index_tables({**tables, "norm_index": R.registry_norms(tables["norms"])})
    found = resolve_spans(stored(X.extract_all(known.select("doc_id", "text")), "stress-spans"), index)
    shown = S.failures_sample(S.verdicts(known, found), known)
    missing = shown.join(removed.select(F.col("old_id").cast("string").alias("id"), F.lit(1).alias("left")), "id", "left")
    return missing.groupBy("section", "form").agg(F.count("*").alias("cases"), F.max("rank").cast("bigint").alias("ranks"), F.count("left").alias("gone"))


_VARIANTS = ["ids novos", "removidos", "normas reescritas", "sem normas", "só normas", "tribunais trocados", "sem índice de texto"]


@query("variant_matrix", "SELECT v AS variant, CAST(lv AS BIGINT) AS level, CAST(1.0 AS DOUBLE) AS macro_f1 FROM (VALUES "
       + ", ".join(f"('{v}')" for v in _VARIANTS) + ") t(v), (VALUES (1), (2)) l(lv)")
def variant_matrix(spark, sf):
    """The same filings against seven versions of the registry, each with the gold that belongs to it; scores by variant.  The registry is parsed once:
    a version is the parsed base without the rows that left, with the few that changed (these alone are parsed), under new ids."""
    raw, b, gold = C.registry_raw(spark, sf), registry(spark, sf), C.gold(spark, sf)
    ids = V.permute_ids(raw)[1]
    removed = stored(_dropped(spark, sf)[1], "removed")
    rewritten, left = _rewritten(spark, sf)
    courts = V.relabel_courts(raw, b["numbers"], gold)
    to_null = lambda table: table.select(F.col("id").alias("old_id"), F.lit(None).cast("bigint").alias("new_id"))

    def parsed(version: DataFrame) -> dict[str, DataFrame]:
        rows = R.build_registry(stored(V.changed_rows(raw, version), "changed"))
        return {name: stored(rows[name], f"changed-{name}") for name in ("records", "decisions", "norms")}
    gone = lambda map_: map_.select(F.col("old_id").alias("id"))
    left = stored(left, "headings-gone")
    versions = {"ids novos": ({"ids": ids}, ids), "removidos": ({"gone": gone(removed)}, removed),
                "normas reescritas": ({"gone": gone(left), "changed": parsed(rewritten)}, left),
                "sem normas": ({"gone": b["norms"].select("id")}, to_null(b["norms"])), "só normas": ({"gone": b["decisions"].select("id")}, to_null(b["decisions"])),
                "tribunais trocados": ({"changed": parsed(courts)}, None), "sem índice de texto": ({}, None)}
    # records of equal text, and of one norm, are equally right
    twin = [b["decisions"].select("id", F.col("signature").alias("k")), b["norms"].filter("norm_key IS NOT NULL").select("id", F.col("norm_key").alias("k"))]
    twins = stored(functools.reduce(DataFrame.unionByName, [t.join(t.withColumnRenamed("id", "twin"), "k").select("id", "twin") for t in twin]), "twins")
    renamed = twins.join(ids.withColumnRenamed("old_id", "id"), "id").select(F.col("new_id").alias("id"), "twin").join(
        ids.withColumnRenamed("old_id", "twin"), "twin").select("id", F.col("new_id").alias("twin"))
    spans = stored(X.extract_all(filings_text(spark, sf)), "variant-spans")
    golds, preds = [], []
    for name, (changes, map_) in versions.items():
        doc = F.concat(F.lit(name + "|"), "doc_id").alias("doc_id")
        of = (renamed if name == "ids novos" else twins).groupBy("id").agg(F.collect_set("twin").alias("twins"))
        g = (gold if map_ is None else V.remap_gold(gold, map_)).join(of, "id", "left")
        golds.append(g.select(doc, F.concat(F.lit(name + "|"), F.col("level").cast("string")).alias("level"), F.xxhash64("span_start", "span_end").alias("idx"),
                              F.col("span_start").alias("start"), F.col("span_end").alias("end"), "label",
                              F.array_compact(F.concat(F.array("id"), F.coalesce("twins", F.array().cast("array<bigint>")))).cast("array<string>").alias("ids")))
        tables = V.version_tables(b, **changes)
        found = resolve_spans(spans, index_tables({**tables, "norm_index": R.registry_norms(tables["norms"])}))
        preds.append(found.select(doc, F.xxhash64("start", "end").alias("idx"), "start", "end", "label", F.col("id").cast("string").alias("id"), F.col("confidence").alias("conf")))
    golds = stored(functools.reduce(DataFrame.unionByName, golds), "variant-gold")
    preds = stored(functools.reduce(DataFrame.unionByName, preds), "variant-pred")
    scores = E.level_scores(E.confusion_events(golds, preds, golds.select("doc_id", "level").distinct()))
    return scores.select(F.substring_index("level", "|", 1).alias("variant"), F.substring_index("level", "|", -1).cast("bigint").alias("level"), "macro_f1")
