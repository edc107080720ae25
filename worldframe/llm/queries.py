"""The registered queries of this subpackage, with production parameters over whole tables."""

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldframe.llm import chat, decontaminate, divergence, htmltext, infill, linededup, packing, quality, records, repeats, simhash, topk, toxicity
from worldframe.llm.common import held_out, shared_dir

TOXIC_FROM, GOOD_FROM = 0.3, 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digest(chat.format_conversations(turns.unionByName(own)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, rules).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/worldframe-records-{uuid.uuid4().hex}"
    records.write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return records.digest(records.read(spark, path))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_toxicity, op3_line_dedup, op4_decontamination, op5_simhash,
        op6_packing, op7_chat_format, op8_quality, op9_html_text, op10_top_k,
        op11_token_records, op12_fill_in_middle, op13_source_divergence,
    )
}

#: By id-pairs in DuckDB: each query against all vectors.
_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""
#: n_turns and the digests of the turns need no template; formatted_chars is that of the template of chat.py.
_CHAT = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    bool_or(contains(text, '<|end|>') OR contains(role, '<|end|>') OR contains(role, '<|text|>') OR contains(text || '<|end|>', '<|end|><|end|>')) AS escaped,
    sum(length(role) + length(text)) AS plain, sum(length(replace(replace(replace(role || text, '~', '~0'), '<', '~1'), '|', '~2'))) AS wide FROM c GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(7 + n_turns * 23 + CASE WHEN escaped THEN wide ELSE plain END AS BIGINT) AS formatted_chars FROM g"""
#: Tokens by RE2, the cuts as lists of tokens.
_INFILL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    d AS (SELECT *, CAST(len(w) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS u FROM t),
    c AS (SELECT *, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u[3] % 100 >= 50 THEN 'plain' WHEN u[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS x, coalesce(array_to_string(w[a + 1:b], ''), '') AS y, coalesce(array_to_string(w[b + 1:n], ''), '') AS z FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
    sha256(CASE WHEN form = 'plain' THEN text ELSE x || y || z END) AS restored_sha256 FROM p"""
#: Every group with every kept term, zeros included.
_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 30), v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d), o AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    n AS (SELECT lang, source, sum(c) AS n FROM o GROUP BY ALL),
    f AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, CAST(1 + (1000000000 * CAST(coalesce(o.c, 0) + 5 AS HUGEINT)) // (coalesce(n.n, 0) + 5 * v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * CAST(k.c + 5 AS HUGEINT)) // (v.n + 5 * v.v) AS BIGINT) AS q FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE c > 0 AND p > q),
    z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM r)
    SELECT * FROM z WHERE part = 'pair' OR rank <= 50"""
ORACLE_SQL: dict[str, str] = {"op12_fill_in_middle": _INFILL, "op13_source_divergence": _DIVERGENCE, "op10_top_k": _TOP_K, "op7_chat_format": _CHAT}
