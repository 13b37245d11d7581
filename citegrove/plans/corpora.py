"""Labelled corpora rendered from the relational test tables.

The test tables hold no legal text, so a registry (from `orders` and `part`) and filings with known citations
(from `orders`) are rendered row by row with plain arithmetic.  The SQL is limited to what Spark and DuckDB share:
Spark runs it to build the input tables, the checks run it to know the truth (offsets, labels, ids) by
construction.  Every filing is rendered within its row, so nothing is grouped or shuffled to build the texts.
"""
import re

from pyspark.sql import DataFrame, SparkSession

from citegrove.plans.tables import once
from citegrove.rules import STATES, UFS

SLOTS = 4          # citations per filing, at most

# sentences around a citation
CARRIERS = [
    ("Nesse mesmo rumo caminha o ", ", lido em sessão sem divergência."),
    ("Vale lembrar o ", ", examinado em caso parecido."),
    ("A tese exposta no ", " segue sem reparo até hoje."),
    ("A sentença contraria o que se lê no ", ". O recurso, por isso, merece provimento."),
    ("Depois de examinar o ", ", a maioria seguiu caminho inverso."),
    ("Cabe mencionar ainda o ", ", cujos argumentos são aqui adotados."),
]
COURT_NAMES = {"STJ": "Superior Tribunal de Justiça", "STF": "Supremo Tribunal Federal",
               "TST": "Tribunal Superior do Trabalho", "TSE": "Tribunal Superior Eleitoral",
               "STM": "Superior Tribunal Militar"}
RAPPORTEURS = ["Nancy Andrighi", "Herman Benjamin", "Og Fernandes", "Ribeiro Dantas", "Dias Toffoli", "Rosa Weber",
               "Luiz Fux", "Kátia Arruda"]

# per court: (acronyms, heading, clean spelling, noisy spelling)
CLASSES = {
    "STJ": [("REsp", "RECURSO ESPECIAL", "REsp", "Rec. Esp."),
            ("AgInt|AREsp", "AgInt no AGRAVO EM RECURSO ESPECIAL", "AgInt no AREsp", "Ag. Int. no A.REsp"),
            ("ED|AgRg|RHC", "EDcl no AgRg no RECURSO EM HABEAS CORPUS", "EDcl no AgRg no RHC",
             "EDcl no AgRg no Recurso em Habeas Corpus"),
            ("HC", "HABEAS CORPUS", "HC", "H.C.")],
    "STF": [("RE", "RECURSO EXTRAORDINÁRIO", "RE", "Recurso Extraordinári0"),
            ("AgRg|ARE", "AG.REG. NO RECURSO EXTRAORDINÁRIO COM AGRAVO", "AgR no ARE", "AG.REG. no ARE"),
            ("AgRg|Rcl", "AG.REG. NA RECLAMAÇÃO", "AgR na Rcl", "AgRg na Rec1amação"),
            ("HC", "HABEAS CORPUS", "HC", "Habeas C0rpus")],
    "TST": [("RR", "Recurso de Revista", "RR", "RR"),
            ("AIRR", "Agravo de Instrumento em Recurso de Revista", "AIRR", "AIRR"),
            ("ED|RR", "Embargos de Declaração em Recurso de Revista", "ED-RR", "ED-RR"),
            ("AIRR", "Agravo de Instrumento em Recurso de Revista", "AIRR", "AIRR")],
    "TSE": [("REspE", "RECURSO ESPECIAL ELEITORAL", "REspe", "RESPE"),
            ("AgRg|AREspE", "AGRAVO REGIMENTAL NO AGRAVO EM RECURSO ESPECIAL ELEITORAL", "AgR no AREspE",
             "AgR-AREspEl"),
            ("REspE", "RECURSO ESPECIAL ELEITORAL", "REspe", "Recurso Especial Eleitora1"),
            ("RO", "RECURSO ORDINÁRIO ELEITORAL", "RO", "Recurso Ordinário")],
    "STM": [("Apl", "APELAÇÃO CRIMINAL", "APL", "Apelação Crirninal"),
            ("RSE", "RECURSO EM SENTIDO ESTRITO", "RSE", "Recurso em Sentid0 Estrito"),
            ("ED|Apl", "EMBARGOS DE DECLARAÇÃO NA APELAÇÃO", "EDcl na APL", "EDcl na Apelação"),
            ("Apl", "APELAÇÃO", "APL", "Apelação")],
}
COURT_ORDER = ["STJ", "STF", "TST", "TSE", "STM"]
JUSTICE = {"STJ": 3, "STF": 1, "TST": 5, "TSE": 6, "STM": 7}

# (code, heading, spellings used in filings)
LAWS = [
    ("L13105", "da Lei nº 13.105, de 16 de março de 2015", ["do CPC", "do Código de Processo Civil",
                                                          "da Lei nº 13.105/2015"]),
    ("L10406", "da Lei nº 10.406, de 10 de janeiro de 2002", ["do CC", "do Código Civil", "do CC/2002"]),
    ("DL5452", "do Decreto-Lei nº 5.452, de 1º de maio de 1943", ["da CLT", "da Consolidação das Leis do Trabalho",
                                                                "do Decreto-Lei nº 5.452/1943"]),
    ("CF", "da Constituição Federal de 1988", ["da CF/88", "da Constituição Federal", "da Constituição da República"]),
    ("DL3689", "do Decreto-Lei nº 3.689, de 3 de outubro de 1941", ["do CPP", "do Código de Processo Penal",
                                                                  "do Decreto-Lei nº 3.689/1941"]),
    ("L8078", "da Lei nº 8.078, de 11 de setembro de 1990", ["do CDC", "do Código de Defesa do Consumidor",
                                                            "da Lei 8.078/90"]),
    ("L4737", "da Lei nº 4.737, de 15 de julho de 1965", ["do Código Eleitoral", "da Lei nº 4.737/1965",
                                                        "do Código Eleitoral"]),
    ("LC64", "da Lei Complementar nº 64, de 18 de maio de 1990", ["da LC 64/90", "da Lei de Inelegibilidades",
                                                                 "da Lei Complementar nº 64/1990"]),
]
COMPLEMENTS = ["", ", I,", ", inciso I,", ", § 1º,", ", caput,", ", parágrafo único,"]


# ------------------------------------------------------------------ shared SQL snippets

def idiv(a: str, b: int) -> str:
    return f"CAST((({a}) - ({a}) % {b}) / {b} AS BIGINT)"


def txt(x: str) -> str:
    return f"CAST({x} AS STRING)"


def pad(x: str, n: int) -> str:
    return f"lpad({txt(x)}, {n}, '0')"


def pick(expr: str, values: list[str]) -> str:
    """values[expr % len]; the values are SQL expressions."""
    branches = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return values[0] if len(values) == 1 else f"CASE ({expr}) % {len(values)} {branches} ELSE {values[-1]} END"


def quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


def dotted(n: str, sep: str = ".", last: str | None = None) -> str:
    """Thousands groups of a positive integer; `last` replaces the separator before the last group."""
    last = sep if last is None else last
    g0, g1, g2 = pad(f"({n}) % 1000", 3), pad(f"{idiv(n, 1000)} % 1000", 3), pad(f"{idiv(n, 1000000)} % 1000", 3)
    return (f"CASE WHEN {n} < 1000 THEN {txt(n)} "
            f"WHEN {n} < 1000000 THEN {txt(idiv(n, 1000))} || '{last}' || {g0} "
            f"WHEN {n} < 1000000000 THEN {txt(idiv(n, 1000000))} || '{sep}' || {g1} || '{last}' || {g0} "
            f"ELSE {txt(idiv(n, 1000000000))} || '{sep}' || {g2} || '{sep}' || {g1} || '{last}' || {g0} END")


def by_court(t: str, column: int, court_key: str | None = None) -> str:
    return pick(court_key or t, [pick(idiv(t, 5), quoted([c[column] for c in CLASSES[court]])) for court in COURT_ORDER])


def court_of(t: str) -> str:
    return pick(t, quoted(COURT_ORDER))


def plain_number(t: str) -> str:
    return f"(100003 + 7 * {t})"


def uf_of(t: str) -> str:
    return pick(idiv(t, 3), quoted(UFS))


def decision_steps(src: str, out: str) -> str:
    """CTEs that add to `src` (keys `t`; `tc` for the class, `tu` for the state) the parts of a decision's citation."""
    justice = pick("t", [str(JUSTICE[c]) for c in COURT_ORDER])
    return f"""
{out}_1 AS (SELECT *, {court_of('t')} AS court, {by_court('tc', 0, 't')} AS acr, {by_court('tc', 1, 't')} AS long_name,
  {by_court('tc', 2, 't')} AS short_name, {by_court('tc', 3, 't')} AS noisy_name, {uf_of('tu')} AS uf,
  {plain_number('t')} AS plain, t % 10000000 AS seq, 2010 + {idiv('t', 10000000)} % 14 AS yr, {justice} AS justice,
  t % 24 + 1 AS tr, {idiv('t', 140000000)} % 10000 AS org FROM {src}),
{out}_2 AS (SELECT *, (((seq * 10000 + yr) * 10 + justice) * 100 + tr) * 10000 + org AS head18 FROM {out}_1),
{out}_3 AS (SELECT *, {dotted('plain')} AS plain_dots, {pad('98 - ((head18 % 97) * 100) % 97', 2)} AS dv,
  {txt('yr')} || '.' || {txt('justice')} || '.' || {pad('tr', 2)} || '.' AS cnj_mid, {pad('org', 4)} AS cnj_org
  FROM {out}_2),
{out} AS (SELECT *, {pad('seq', 7)} || '-' || dv || '.' || cnj_mid || cnj_org AS cnj,
  {txt('seq')} || '-' || dv || '.' || cnj_mid || cnj_org AS cnj_short FROM {out}_3)"""


def decision_id(t: str) -> str:
    return f"(10000000000 + {t} * 10)"


def norm_id(j: str) -> str:
    return f"(9000000000000 + {j} * 10)"


def norm_kind(j: str) -> str:
    return f"CASE WHEN {j} % 4 = 0 THEN 'sumula' WHEN {j} % 4 = 1 THEN 'vinculante' ELSE 'artigo' END"


def norm_court(j: str) -> str:
    return f"CASE WHEN {j} % 4 = 1 THEN 'STF' ELSE {pick(idiv(j, 4), quoted(['STJ', 'STF', 'TST', 'TSE']))} END"


def norm_number(j: str) -> str:
    return (f"CASE WHEN {j} % 4 = 0 THEN {idiv(j, 16)} + 1 WHEN {j} % 4 = 1 THEN {idiv(j, 4)} + 1 "
            f"ELSE {idiv(j, 32)} * 2 + {j} % 4 - 1 END")


def norm_law(j: str) -> str:
    return pick(idiv(j, 4), quoted([law[0] for law in LAWS]))


def norm_key(j: str) -> str:
    """'sumula|STJ|false|83' or 'artigo|L13105|373'."""
    return (f"CASE WHEN {j} % 4 < 2 THEN 'sumula|' || {norm_court(j)} || '|' || "
            f"CASE WHEN {j} % 4 = 1 THEN 'true' ELSE 'false' END || '|' || {txt(norm_number(j))} "
            f"ELSE 'artigo|' || {norm_law(j)} || '|' || {txt(norm_number(j))} END")


def norm_in_base(j: str) -> str:
    return f"({j} % 5 <> 0 AND {j} % 29 <> 0)"


# ------------------------------------------------------------------ registry

def exploded(spark: bool, n: str) -> str:
    """0..n-1 as rows."""
    return f"explode(sequence(CAST(0 AS BIGINT), {n} - 1))" if spark else f"unnest(range(0, CAST({n} AS BIGINT)))"


def registry_steps(spark: bool = False) -> str:
    """CTEs up to `dec` (one row per record of a decision: a the record, b a namesake with the same number in another
    class and state, c a copy with the same text) and `nor` (one row per record of a norm)."""
    state = pick(idiv("tu", 3), quoted([{v: k for k, v in STATES.items()}[u] for u in UFS]))
    heading = f"""CASE t % 5
  WHEN 0 THEN 'Superior Tribunal de Justiça ' || long_name || ' Nº ' || plain_dots || ' - ' || uf || ' (2021/0123456-7) RELATOR : MINISTRO ' || rapp
  WHEN 1 THEN 'Supremo Tribunal Federal 22/04/2026 PRIMEIRA TURMA ' || long_name || ' ' || plain_dots || ' ' || state || ' RELATOR : MIN. ' || rapp
  WHEN 2 THEN 'Tribunal Superior do Trabalho A C Ó R D Ã O Vistos, relatados e discutidos estes autos de ' || long_name || ' nº TST-' || short_name || '-' || cnj_short || ', em que é relator ' || rapp
  WHEN 3 THEN 'TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO ' || long_name || ' Nº ' || CASE WHEN t % 2 = 0 THEN plain_dots || ' ( ' || cnj || ' )' ELSE cnj END || ' - CLASSE 32 RELATOR: MINISTRO ' || rapp
  ELSE 'SUPERIOR TRIBUNAL MILITAR Pleno ' || long_name || ' Nº ' || cnj || '/' || uf || ' RELATOR: MINISTRO ' || rapp END
  || ' EMENTA. Recurso conhecido. Pedido ' || CAST(o_custkey AS STRING) || ' do grupo ' || o_orderpriority || ' em '
  || o_orderstatus || '. DECIDE a Turma negar provimento, nos termos do voto do relator.'"""
    law_heading = pick(idiv("j", 4), quoted([law[1] for law in LAWS]))
    return f"""
d0 AS (SELECT o_orderkey AS t, o_custkey, o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS ano,
  1 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS records
  FROM {{orders}} WHERE o_orderkey % 7 <> 0),
d1 AS (SELECT *, {exploded(spark, 'records')} AS r FROM d0),
d2 AS (SELECT *, CASE WHEN r = 0 THEN 'a' WHEN r = 1 AND t % 11 = 0 THEN 'b' ELSE 'c' END AS variant FROM d1),
d3 AS (SELECT *, t + CASE WHEN variant = 'b' THEN 5 ELSE 0 END AS tc,
  t + CASE WHEN variant = 'b' THEN 3 ELSE 0 END AS tu FROM d2),{decision_steps('d3', 'd4')},
d5 AS (SELECT *, {pick('t', quoted([r.upper() for r in RAPPORTEURS]))} AS rapp, {state} AS state FROM d4),
dec AS (SELECT t, variant, court, acr, uf, CASE WHEN t % 5 < 2 THEN CAST(plain AS STRING) ELSE cnj END AS number,
  CASE WHEN t % 5 = 3 AND t % 2 = 0 THEN CAST(plain AS STRING) END AS alias,
  {decision_id('t')} + CASE variant WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END AS id,
  'dec_' || {pad('t', 12)} || variant AS documento_id,
  CASE WHEN t % 17 = 0 THEN NULL WHEN t % 19 = 0 THEN 'TRF4' WHEN t % 23 = 0 THEN ' ' || lower(court) || ' '
    ELSE court END AS tribunal,
  CASE WHEN t % 31 = 0 THEN 'Acordao ' ELSE 'acordao' END AS natureza, ano,
  'Min. ' || {pick('t', quoted(RAPPORTEURS))} AS relator, {heading} AS texto FROM d5),
n0 AS (SELECT p_partkey AS j, p_name, p_brand, 1 + CASE WHEN p_partkey % 37 = 0 THEN 1 ELSE 0 END AS records
  FROM {{part}} WHERE p_partkey % 5 <> 0),
n1 AS (SELECT *, {exploded(spark, 'records')} AS r FROM n0),
n2 AS (SELECT *, {norm_number('j')} AS n, {norm_court('j')} AS court FROM n1),
nor AS (SELECT j, {norm_id('j')} + r AS id, 'nor_' || {pad('j', 12)} || CASE WHEN r = 0 THEN 'a' ELSE 'b' END AS documento_id,
  CASE WHEN j % 4 < 2 THEN court END AS tribunal,
  CASE WHEN j % 3 = 0 AND j % 29 <> 0 THEN NULL WHEN j % 4 < 2 THEN 'sumula' ELSE 'dispositivo' END AS natureza,
  CASE WHEN j % 29 <> 0 THEN {norm_key('j')} END AS norm_key,
  CASE WHEN j % 29 = 0 THEN 'Texto sem linha de identificação.' WHEN j % 4 = 0 AND j % 6 = 4 THEN 'Súmula ' || {txt('n')}
    WHEN j % 4 = 0 THEN 'Súmula n. ' || {txt('n')} || ' do ' || court
    WHEN j % 4 = 1 THEN 'Súmula Vinculante n. ' || {txt('n')} || ' do STF'
    ELSE 'Artigo ' || {dotted('n')} || CASE WHEN n < 10 THEN 'º' ELSE '' END || ' ' || {law_heading} END
    || '\n' || 'Texto da norma ' || p_name || ', marca ' || p_brand || '.' AS texto FROM n2)"""


def registry_sql(spark: bool = False) -> str:
    """registry_raw(id, documento_id, tribunal, natureza, ano, relator, texto)."""
    return f"""WITH {registry_steps(spark)}
SELECT id, documento_id, tribunal, natureza, ano, relator, texto FROM dec
UNION ALL
SELECT id, documento_id, tribunal, natureza, CAST(NULL AS BIGINT), CAST(NULL AS STRING), texto FROM nor"""


# ------------------------------------------------------------------ filings and gold

def filing_steps(spark: bool = False) -> str:
    """CTEs up to `sentences`: one row per sentence i of filing k, with the citation, what stands around it and the
    keys it refers to (t a decision, u the second decision of an enumeration, j a norm)."""
    two, v = "level = 2", "v"
    w = "(k + i + v)"
    docket = f"""CASE WHEN t % 5 = 2 THEN CASE WHEN {two} AND v % 2 = 1 THEN 'TST-' ELSE 'processo nº TST-' END || name || '-' || num
  ELSE name || ' ' || CASE WHEN {two} THEN {pick(w, quoted(['nº', 'n.', 'N°', 'n.º']))} ELSE 'nº' END || ' ' || num
  || CASE WHEN {two} THEN {pick(v, quoted(['/', ' - ', '/ ']))} ELSE '/' END || uf END"""
    law = pick(idiv("j", 4), [pick(w, quoted(names)) for _, _, names in LAWS])
    norm = f"""CASE WHEN j % 4 = 1 THEN {pick(v, quoted(['Súmula Vinculante ', 'SV ', 'Súmula Vinculante nº ']))} || {txt('n')}
  WHEN j % 4 = 0 THEN CASE WHEN {two} THEN {pick(v, quoted(['5úmula ', 'SÚMULA ', 'Súm. ']))}
    ELSE {pick(v, quoted(['Súmula ', 'Súmula nº ', 'Súmula n. ']))} END || {txt('n')}
    || {pick(w, quoted([' do ', '/', ' do ', '/', ' do ']))} || norm_court
  ELSE {pick(v, quoted(['art. ', 'artigo ', 'Art. ']))} || CASE WHEN n < 10 THEN {txt('n')} || 'º' ELSE {dotted('n')} END
    || {pick(w, quoted(COMPLEMENTS))} || ' ' || {law} END"""
    rapp, ano = pick(w, quoted(RAPPORTEURS)), "CAST(2001 + k % 24 AS STRING)"
    incomplete = pick(v, [
        f"'acórdão do ' || court || ' firmado em ' || {ano} || ' sob a relatoria de ' || rapp",
        f"'voto do ' || court || ' de ' || {ano} || ', pela relatoria de ' || rapp",
        f"'precedente do ' || court || ' lavrado em ' || {ano} || ' sob relatoria da ' || rapp",
        f"'aresto do ' || court || ', de relatoria da Ministra ' || rapp || ', proferido em ' || {ano}",
        f"'decisão do ' || court || ' de ' || {ano} || ' (Rel. Min. ' || rapp || ')'"])
    theme = f"'Tema ' || {dotted('(1 + k % 3000)')} || {pick(v, quoted([' do STJ', '', ' da repercussão geral']))}"
    distractor = pick(v, [
        "'documento de fls. ' || CAST(10 + k % 890 AS STRING) || '/' || CAST(10 + k % 877 AS STRING)",
        "'Autos nº ' || cnj", "'Guia nº 2023.' || CAST(100000 + k AS STRING)",
        f"'crédito de R$ ' || {dotted('(1000 + k)')} || ',35'", "'enunciado 12 da II Jornada de Direito Comercial'"])
    # noisy forms of a number: run together, spaced, broken after a dot, with letters for digits
    num = f"""CASE WHEN t % 5 < 2 THEN CASE WHEN level = 1 OR v = 0 THEN plain_dots WHEN v = 1 THEN {txt('plain')}
    WHEN v = 2 THEN replace(plain_dots, '.', ' ') WHEN v = 3 THEN replace(plain_dots, '.', '. ')
    ELSE replace(plain_dots, '0', 'O') END
  ELSE CASE WHEN level = 1 OR v = 0 THEN cnj WHEN v = 1 THEN cnj_short
    WHEN v = 2 THEN lpad({txt('seq')}, 7, '0') || '-' || dv || ' ' || replace(cnj_mid, '.', ' ') || cnj_org
    WHEN v = 3 THEN {txt('seq')} || '-' || dv || '.' || cnj_mid || '\n' || cnj_org
    ELSE lpad({txt('seq')}, 7, '0') || '-' || dv || '.' || replace(cnj_mid, '1', 'l') || cnj_org END END"""
    q = "(k + 3 * i) % 10"
    doc_id = f"'doc_' || {pad('k', 12)} AS doc_id, "
    return f"""
f0 AS (SELECT o_orderkey AS k, {'doc_id, ' if spark else ''}1 + o_orderkey % 2 AS level, 1 + o_orderkey % {SLOTS} AS n_sent FROM {{{'filed' if spark else 'orders'}}}),
fs AS (SELECT *, {exploded(spark, 'n_sent')} AS i FROM f0),
f2 AS (SELECT *, CASE WHEN {q} < 5 THEN 'docket' WHEN {q} = 5 THEN 'chain' WHEN {q} < 8 THEN 'norm'
    WHEN {q} = 8 THEN 'incomplete' WHEN k % 4 < 2 THEN 'theme' ELSE 'distractor' END AS form,
  CASE WHEN i = 0 AND k % 3 = 0 THEN 15 ELSE k - k % 1000 + (k * 31 + i * 97 + 11) % 1000 END AS t,
  (k * 13 + i * 7) % 1000 AS j, (k + {idiv('k', 10)} + i) % 5 AS v FROM fs),
f3 AS (SELECT *, t AS tc, t AS tu, CASE WHEN (t + 5) % 11 = 0 THEN t + 10 ELSE t + 5 END AS u,
  {norm_number('j')} AS n, {norm_court('j')} AS norm_court FROM f2),{decision_steps('f3', 'f4')},
f5 AS (SELECT *, CASE WHEN {two} AND v % 2 = 1 THEN noisy_name ELSE short_name END AS name, {num} AS num,
  {plain_number('u')} AS plain_u, {uf_of('u')} AS uf_u, {rapp} AS rapp FROM f4),
f6 AS (SELECT *, CASE WHEN form = 'chain' AND t % 5 < 2 THEN name || ' ' || plain_dots || '/' || uf END AS head FROM f5),
f7 AS (SELECT *, CASE WHEN head IS NOT NULL THEN head || ' e ' || {dotted('plain_u')} || '/' || uf_u
    WHEN form IN ('docket', 'chain') THEN {docket} WHEN form = 'norm' THEN {norm} WHEN form = 'incomplete' THEN {incomplete}
    WHEN form = 'theme' THEN {theme} ELSE {distractor} END AS cite,
  {pick(w, quoted([x[0] for x in CARRIERS]))} AS pre, {pick(w, quoted([x[1] for x in CARRIERS]))} AS post FROM f6),
sentences AS (SELECT *, {'' if spark else doc_id}pre || cite || post AS sentence,
  CASE WHEN k % 5 = 0 THEN '\n\n' ELSE ' ' END AS gap FROM f7)"""


def filings_sql(spark: bool = False) -> str:
    """One text per filing: at most four sentences, put together with bounded aggregates."""
    parts = ", ".join(f"max(CASE WHEN i = {i} THEN sentence END) AS s{i}" for i in range(SLOTS))
    text = "s0" + "".join(f" || coalesce(gap || s{i}, '')" for i in range(1, SLOTS))
    return (f"WITH {filing_steps(spark)},\ndocs AS (SELECT doc_id, level, gap, {parts} FROM sentences "
            f"GROUP BY doc_id, level, gap)\nSELECT doc_id, CAST(level AS BIGINT) AS level, {text} AS text FROM docs")


def cited_sql(spark: bool = False) -> str:
    """CTEs up to `cited`: one row per citation with its position and what it refers to."""
    kind = ("CASE form WHEN 'norm' THEN CASE WHEN j % 4 < 2 THEN 'sumula' ELSE 'artigo' END "
            "WHEN 'incomplete' THEN 'incompleta' WHEN 'theme' THEN 'tema' ELSE 'acordao' END")
    if spark:
        return filing_steps(spark) + f""",
measured AS (SELECT *, length(pre) AS n_pre, length(cite) AS n_cite, length(head) AS n_head, length(sentence) + length(gap) AS n_all
  FROM sentences),
placed AS (SELECT *, sum(n_all) OVER (PARTITION BY doc_id ORDER BY i) - n_all + n_pre AS opens FROM measured),
cited AS (SELECT * FROM (SELECT doc_id, level, inline(array(
    struct(form <> 'distractor' AS here, i * 2 AS slot, {kind} AS kind, opens AS span_start, opens + coalesce(n_head, n_cite) AS span_end,
      CASE WHEN form IN ('docket', 'chain') THEN t END AS t, CASE WHEN form = 'norm' THEN j END AS j, acr, CASE WHEN t % 5 <> 2 THEN uf END AS uf),
    struct(n_head IS NOT NULL AS here, i * 2 + 1 AS slot, 'acordao' AS kind, opens + n_head + 3 AS span_start, opens + n_cite AS span_end,
      u AS t, CAST(NULL AS BIGINT) AS j, acr, uf_u AS uf))) FROM placed) WHERE here)"""
    return filing_steps(spark) + f""",
placed AS (SELECT *, sum(length(sentence) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) - length(sentence)
  - length(gap) + length(pre) AS opens FROM sentences),
cited AS (SELECT doc_id, level, i * 2 AS slot, {kind} AS kind, opens AS span_start,
    opens + coalesce(length(head), length(cite)) AS span_end, CASE WHEN form IN ('docket', 'chain') THEN t END AS t,
    CASE WHEN form = 'norm' THEN j END AS j, acr, CASE WHEN t % 5 <> 2 THEN uf END AS uf FROM placed
    WHERE form <> 'distractor'
  UNION ALL
  SELECT doc_id, level, i * 2 + 1, 'acordao', opens + length(head) + 3, opens + length(cite), u, NULL, acr, uf_u FROM placed
    WHERE head IS NOT NULL)"""


def truth_sql(spark: bool = False) -> str:
    """CTEs up to `truth`: `cited` with label and canonical id, known from the keys alone."""
    def asked(key: str, known: str) -> str:
        # rows without a key match nothing; on Spark a hash deals them out, as they would all go to one task
        return f"coalesce({key}, xxhash64(c.doc_id, c.slot)) = {known} AND {key} IS NOT NULL" if spark else f"{key} = {known}"
    return (cited_sql(spark) + f""",
norm_owner AS (SELECT p_partkey AS j, {norm_id('p_partkey')} + CASE WHEN p_partkey % 37 = 0 THEN 1 ELSE 0 END AS id
  FROM {{part}} WHERE {norm_in_base('p_partkey')}),
truth AS (SELECT c.doc_id, CAST(c.level AS BIGINT) AS level, CAST(c.slot AS BIGINT) AS slot, c.kind,
    CAST(c.span_start AS BIGINT) AS span_start, CAST(c.span_end AS BIGINT) AS span_end, c.t, c.j, c.acr, c.uf,
    CASE WHEN c.kind = 'incompleta' THEN 'incompleta' WHEN o.o_orderkey IS NOT NULL OR n.j IS NOT NULL THEN 'real'
         ELSE 'inventada' END AS label,
    CASE WHEN o.o_orderkey IS NOT NULL THEN {decision_id('c.t')} ELSE n.id END AS id
  FROM cited c
  LEFT JOIN (SELECT o_orderkey FROM {{orders}} WHERE o_orderkey % 7 <> 0) o ON {asked('c.t', 'o.o_orderkey')}
  LEFT JOIN norm_owner n ON {asked('c.j', 'n.j')})""")


def gold_sql(spark: bool = False) -> str:
    steps = "truth AS (SELECT * FROM {truth})" if spark else truth_sql()
    return ("WITH " + steps + "\nSELECT doc_id, level, 'c' || CAST(slot AS STRING) AS cit_id, span_start, "
            "span_end, kind, label, id FROM truth")


# ------------------------------------------------------------------ Spark side

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt out over all tasks: a file of few row groups is read by as few tasks, and texts are rendered from short rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: spread(table(spark, sf_dir, n)) for n in names})


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the filings dealt out by document, so that what is rendered of a document lies in one task and neither its texts nor its
    positions are moved again.  A null key has no filing."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey").filter("o_orderkey IS NOT NULL")
    named = keys.selectExpr("o_orderkey", f"'doc_' || {pad('o_orderkey', 12)} AS doc_id")
    return named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def run_filings(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """`run_sql` with the filings' keys beside the tables."""
    return spark.sql(sql, filed=filed(spark, sf_dir), **{n: spread(table(spark, sf_dir, n)) for n in names})


def registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = run_sql(spark, sf_dir, registry_sql(spark=True), "orders", "part")
        return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "documento_id")
    return once(spark, sf_dir, "registry_raw", build)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "filings", lambda: run_filings(spark, sf_dir, filings_sql(spark=True)))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations with label and id: the filings are rendered once for all that is derived from them."""
    return once(spark, sf_dir, "truth", lambda: run_filings(
        spark, sf_dir, f"WITH {truth_sql(spark=True)} SELECT * FROM truth", "orders", "part"))


def from_truth(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, truth=truth(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_truth(spark, sf_dir, gold_sql(spark=True))


# steps that are read several times are worked out once
_MANY_READERS = re.compile(r"\b(sentences|placed|truth|base|gold|pred|good|m|mm|free|extra|missed|res) AS \((?=SELECT)")


def duck(sql: str) -> str:
    """The same SQL over the tables as the checking engine knows them."""
    return _MANY_READERS.sub(r"\1 AS MATERIALIZED (", sql.format(orders="orders", part="part"))
