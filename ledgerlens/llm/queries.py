"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn
    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# Words of a text in DuckDB: lower-case A-Z only, then the word runs.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP2 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[s + 1 : s + size], ' ') AS win
       FROM (SELECT item_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM i)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, s, array_to_string(w[s + 1 : s + size], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, s, dw.size, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id"""


@register("op2_decontamination", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerlens.llm.token_files import read_token_index, write_token_files

    folder = write_token_files(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return read_token_index(spark, folder)


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.toxicity import THRESHOLD, add_toxicity, fit

    docs = table(spark, sf_dir, "documents")
    scored = add_toxicity(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")), "score")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.mixing import mix_to_targets

    out = mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "mix_tokens", "mix_domains", "mix_rate", "mix_copies", "mix_residual")


@register("op10_weighted_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.weighted_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op3_vector_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.vector_dedup import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"))


_OP6_ROWS = """SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'"""


def _escaped(column: str) -> str:
    from ledgerlens.llm.chat_trees import CONTROL

    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_OP6 = f"""WITH c AS ({_OP6_ROWS})
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(4 + length({_escaped('role')}) + length({_escaped('text')}) + 7) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


@register("op6_chat_trees", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.chat_trees import chain, digest, format_branches
    from ledgerlens.llm.common import materialize

    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    messages = materialize(chain(rows.unionByName(extra)), "messages")
    out = digest(materialize(format_branches(messages), "formatted"))
    return out.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), "n_turns", "turns_sha256",
                      "loss_chars", "loss_sha256", "formatted_chars")


@register("op5_site_templates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.site_templates import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@register("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@register("op1_quality_lm")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.quality_lm import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_cross_tokens")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerlens.llm.cross_tokens import cross_alignment

    return cross_alignment(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
                           str(public_tokenizers.path("piece_bpe_32k.model")))


@register("op12_importance")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.importance import importance

    out = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_OP13 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


@register("op13_vector_search", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.vector_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))
