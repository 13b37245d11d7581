"""Steps whose cost must follow the rows, not the files they stand in or the signs a rule lists."""
import re
import unicodedata

import duckdb
from pyspark.sql import functions as F

from citegrove.functions import numbers as N, text as T
from citegrove.functions.grammar import by_beginning
from citegrove.operators import patterns as P, prepare, variants
from citegrove.plans import corpora as C, queries_core, queries_eval, queries_variants, tables
from citegrove.rules import CLASS_VOCABULARY


def test_rows_of_one_row_group_are_rendered_by_all_tasks(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS o_orderkey").union(spark.sql("SELECT CAST(NULL AS BIGINT) UNION ALL SELECT CAST(7 AS BIGINT)"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    out = C.run_sql(spark, str(tmp_path), "SELECT o_orderkey, spark_partition_id() AS task FROM {orders}", "orders").collect()
    assert sorted((r.o_orderkey for r in out), key=str) == sorted([*range(500), 7, None], key=str)
    sizes = [sum(r.task == t for r in out) for t in {r.task for r in out}]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1 and max(sizes) < 2 * min(sizes) + 8


def test_plain_stretches_are_one_piece(spark):
    texts = ["a" * 3000 + "é" + "b" * 3000, "pa­ra “mim” 한क़ ệx—", "́a​́", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    pieces = docs.select("doc_id", F.size(prepare._cluster_pieces(F.col("text"))).alias("n")).filter("doc_id = 0").first()
    assert pieces.n == 3
    out = {r.doc_id: r for r in prepare.prepare_text(docs).collect()}
    long = out[0]
    assert long.prepared == unicodedata.normalize("NFC", texts[0])
    assert long.map_start == [*range(3001), *range(3002, 6002)] and long.map_end == [*range(1, 3001), *range(3002, 6003)]
    assert out[1].prepared == 'para "mim" 한क़ ệx-'
    assert out[1].map_start == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 15, 16, 17, 20, 21]
    assert out[1].map_end == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 16, 17, 20, 21, 22]
    assert out[3].prepared == "" and out[3].map_start is None and out[4].prepared is None


def test_words_that_begin_alike_share_a_branch():
    words = [P._known_signs(w) for w in CLASS_VOCABULARY]
    plain, shared = "|".join("".join(w) for w in words), by_beginning(words)
    assert shared.count("|") < plain.count("|")
    worn = [w.translate(str.maketrans("OSLI", "051L")) for w in CLASS_VOCABULARY] + [w.replace("M", "RN") for w in CLASS_VOCABULARY]
    tried = [*CLASS_VOCABULARY, *worn, *[w[:-1] for w in CLASS_VOCABULARY], *[w + "X" for w in CLASS_VOCABULARY], "", "0"]
    assert all(bool(re.fullmatch(plain, w)) == bool(re.fullmatch(shared, w)) for w in tried)


def test_numbers_after_an_ordinal_or_a_stop_are_read_at_once(spark):
    usual = ["REsp nº 1.741.784/PR, lido", "REsp N° 1.741.784", "REsp n. 1.741.784/PR", "Rec. Esp. 45 e"]
    other = ["nº1.741", "nºl 123", "§ 1º, do CPP", "nº 12) nº", "x. 12, ab-O", "n. 9 9; n.l."]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(usual + other)], "i int, t string")
    zones = texts.select("i", F.explode(N.zones(F.col("t"))).alias("z")).select("i", N._plain_runs(F.col("z")).alias("plain"), N._runs(F.col("z")).alias("full")).collect()
    assert all(r.plain is not None for r in zones if r.i < len(usual)) and {r.i for r in zones} >= set(range(len(usual)))
    assert all(r.plain is None or r.plain == r.full for r in zones)


def test_noise_is_read_as_by_its_rules(spark):
    signs = ["5", "9", "0", "O", "l", "L", "a", "o", "v", "x", "é", "ª", "º", ".", "-", " ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "日", "٣", "/", "ß", "µ", "×"]
    texts = [a + b + c + "5" for a in signs for b in signs for c in signs[:16]] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shape = F.col("t")
    for found, kind in T._SHAPE_OF:
        shape = F.regexp_replace(shape, "(?U)" + found, kind)
    by_rules = F.contains("t", F.lit("\n")) | shape.rlike("|".join(T.NOISE_SHAPES))
    assert df.filter(~T.noise_flag(F.col("t")).eqNullSafe(by_rules)).count() == 0


def test_norms_are_read_without_parsing_decisions(spark, tmp_path):
    spark.sql("""SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, DATE'2020-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority
              FROM range(1, 40)""").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS p_partkey, 'p' AS p_name, 'b' AS p_brand FROM range(1, 40)").write.parquet(f"{tmp_path}/part.parquet")
    kept = queries_variants.keep_only(spark, str(tmp_path)).count()
    keys = queries_core.registry_norms(spark, str(tmp_path)).agg(F.sum("records")).first()[0]
    assert kept == sum(1 + (j % 37 == 0) for j in range(1, 40) if j % 5) and 0 < keys <= kept
    assert not [k for k in tables._once if k[1] == str(tmp_path) and k[2] == "decisions"]


def _odd_tables(spark, path):
    keys = [*range(1, 400), 15, 15, 22, 22, 22, 1001, 1020, None, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k,) for k in [*range(1, 200), 37, 37, 41, None]], "p_partkey bigint").coalesce(1).write.parquet(f"{path}/part.parquet")


def test_truth_renders_the_filings_once(spark, tmp_path):
    _odd_tables(spark, tmp_path)
    rows = C.run_filings(spark, str(tmp_path), f"WITH {C.truth_sql(True)} SELECT * FROM truth", "orders", "part")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 1
    db = duckdb.connect()
    for name in ("orders", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = "doc_id, level, slot, kind, span_start, span_end, t, j, acr, uf, label, id"
    known = db.execute(C.duck(f"WITH {C.truth_sql()} SELECT {columns} FROM truth")).fetchall()
    assert sorted(map(str, known)) == sorted(str(tuple(r)) for r in rows.selectExpr(*columns.split(", ")).collect())


def test_truth_is_what_gold_and_predictions_are_read_from(spark, tmp_path):
    _odd_tables(spark, tmp_path)
    truth = set(C.truth(spark, str(tmp_path)).inputFiles())
    read = [C.gold(spark, str(tmp_path)), *queries_eval.both(spark, str(tmp_path))]
    assert all(set(df.inputFiles()) == truth for df in read)


def test_gold_without_ids_is_dealt_out(spark):
    gold = spark.range(4000).selectExpr("concat('d', id) AS doc_id", "id AS span_start", "CASE WHEN id % 8 = 0 THEN 'real' ELSE 'inventada' END AS label",
                                        "CASE WHEN id % 8 = 0 THEN id END AS id")
    ids = spark.range(0, 4000, 16).selectExpr("id AS old_id", "CASE WHEN id % 32 = 0 THEN id + 1 END AS new_id").hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # which would put small partitions together
    try:
        out = variants.remap_gold(gold, ids).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(out) == 4000 and sum(r.label == "real" for r in out) == 375 and sum(r.id is not None for r in out) == 375
    assert {r.id for r in out if r.span_start == 32} == {33} and [r.label for r in out if r.span_start == 16] == ["inventada"]
    free = [r.task for r in out if r.span_start % 8]
    assert max(free.count(t) for t in set(free)) < 2 * len(free) / 4


def test_the_start_of_a_rapporteur_rule_drops_no_match(spark):
    from citegrove.functions.spans import match_spans
    from citegrove.operators import patterns as P
    assert P.RAPPORTEUR.count(P.RAPPORTEUR_START) == 1
    texts = ["julgado da relatoria do Min. Dias Toffoli", "SOB A RELATORIA DE Ayres Britto", "ſob relatoria de Ayres Britto", "(Rel. Min. Luiz Fux)", "( rel. Luiz Fux",
             "correl. Luiz Fux", "relatado pelo Ministro Luiz Fux", "pelo relator de Luiz Fux", "nada aqui", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", match_spans(F.col("text"), P.RAPPORTEUR).alias("now"), match_spans(F.col("text"), P.RAPPORTEUR.replace(P.RAPPORTEUR_START, "")).alias("plain")).collect()
    assert all(r.now == r.plain for r in rows) and sum(r.now is not None for r in rows) >= 6


def test_numbers_among_other_words_are_read_at_once(spark):
    """Words without a digit after a number, and an acronym with a hyphen before it, leave its zone a usual one."""
    usual = ["REsp nº 988.338 - AL, cujos", "autos de RR nº TST-RR-0023522-04.20l0.5.03.0000. O recurso", "em 2014 sob a relatoria", "TST-AIRR-65-63.2010.5.01.0075 segue",
             "REsp 12 - O S - x"]
    other = ["TST-RR-12(nº", "o 5úmula", "§ 1º, do", "RR- 12 l 9", "nºRR-12 - a", "TST-RR-1.2349./º|", "ab-O-12 9 - ,", "TSTO-12 -"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(usual + other)], "i int, t string")
    zones = texts.select("i", F.explode(N.zones(F.col("t"))).alias("z")).select("i", N._plain_runs(F.col("z")).alias("plain"), N._runs(F.col("z")).alias("full")).collect()
    assert all(r.plain is not None for r in zones if r.i < len(usual)) and {r.i for r in zones} >= set(range(len(usual)))
    assert all(r.plain is None or r.plain == r.full for r in zones)


def test_a_class_run_is_looked_for_after_the_last_other_word(spark):
    signs = ["REsp", "AgInt", "no", "(REsp", "nº", "Recurso", "Especial", "e,HC", "Rec.", "RE-AgR", "x;RE", "foo", "/", "TST-RR-", "NOAGRAVO", "\n", " ", "E1", "em,"]
    texts = [(f"{a} {b}{gap}{c}{end}",) for a in signs for b in signs for c in signs for gap, end in ((" ", " "), ("\n", ""))] + [("",), (None,), (" " * 9,)]
    folded = T.fold_same_length(F.col("t"))
    df = spark.createDataFrame(texts, "t string").select(
        F.regexp_replace(folded, P.BEFORE_RUN, "").alias("rest"), folded.alias("whole"))
    run = lambda c: F.regexp_extract(F.col(c), P.KNOWN_RUN, 0)
    assert df.filter(run("rest") != run("whole")).count() == 0 and df.filter(run("whole") != "").count() > 1000
    assert df.filter("rest <> whole").count() > 1000


def test_signs_are_looked_up_only_where_they_are_swapped(spark):
    assert all(re.fullmatch(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), prepare._SWAPPED), c) for c in prepare._SWAP_FROM)
    df = spark.createDataFrame([("a \u2013 b", "a - b"), ("a\x07b", "a b"), ("plain ç", "plain ç"), ("\ue000x", "\ue000x")], "text string, wanted string")
    assert all(r.prepared == r.wanted for r in prepare.prepare_text(df).collect())
