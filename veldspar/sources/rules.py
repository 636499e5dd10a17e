"""Rule files in Markdown, and the engine's settings from YAML and the environment."""

from __future__ import annotations

import os
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rules(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """(file, text) of the Markdown files under path; a required name that is missing is an error."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    if required:
        found = {r.file for r in rows.select("file").where(F.col("file").isin(required)).collect()}
        if missing := sorted(set(required) - found):
            raise FileNotFoundError(f"rule files are missing: {', '.join(missing)}")
    return rows


def sections(rules: DataFrame) -> DataFrame:
    """(file, pos, title, bullets, code, table_rows) of the `## ` sections."""
    parts = F.split("text", r"(?m)^## ")
    x = rules.select("file", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))).alias("pos", "s"))
    each = lambda p: F.regexp_extract_all("s", F.lit(p), F.lit(1))
    return x.select("file", "pos", F.trim(F.split_part("s", F.lit("\n"), F.lit(1))).alias("title"), each(r"(?m)^\s*[-*•]\s+(.+)$").alias("bullets"), each(r"(?s)```\w*\n(.*?)```").alias("code"), each(r"(?m)^(\|.*\|)\s*$").alias("table_rows"))


def thresholds(rules: DataFrame) -> DataFrame:
    """One row of limits that the rules state: the smallest count of words and paragraphs, the sources of a
    report, the quality score, domains and forbidden practices. What is not stated is null."""
    number = lambda p: F.max(F.regexp_extract("text", p, 1).try_cast("int"))
    gathered = lambda p: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(p), F.lit(1))))))
    return rules.agg(
        number(r"word_count\s*>=\s*([0-9]+)").alias("min_words"), number(r"paragraph_count\s*>=\s*([0-9]+)").alias("min_paragraphs"), number(r"(?s)TOPLAM RAPOR.*?([0-9]+)").alias("min_sources"),
        number(r"Toplam puan.*?\*\*([0-9]+)").alias("min_quality"), gathered(r"\|\s*([\w.]+\.(?:gov\.tr|org\.tr|com|org))\s*\|").alias("domains"), gathered(r"❌\s*(.+)").alias("forbidden"),
    )


def prompt_text(rules: DataFrame) -> DataFrame:
    """All rules in order of their files, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("file", "text")))
    return rules.agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("text"))


# Section, key and default of each setting, and what it may be: a range or a choice of names.
SETTINGS = [
    ("embedding", "model", "intfloat/multilingual-e5-large", None),
    ("embedding", "dimension", 1024, (1, None)),
    ("embedding", "batch_size", 32, (1, None)),
    ("embedding", "max_length", 512, (1, None)),
    ("embedding", "normalize", True, None),
    ("embedding", "device", "auto", None),
    ("embedding", "use_fp16", False, None),
    ("embedding", "cache_embeddings", True, None),
    ("embedding", "fallback_model", "paraphrase-multilingual-MiniLM-L12-v2", None),
    ("embedding", "fallback_dimension", 384, (1, None)),
    ("chunking", "strategy", "semantic", None),
    ("chunking", "chunk_size", 1200, (50, 10000)),
    ("chunking", "chunk_overlap", 240, (0, None)),
    ("chunking", "min_chunk_size", 200, (0, None)),
    ("chunking", "max_chunk_size", 2000, (1, None)),
    ("chunking", "preserve_sentences", True, None),
    ("chunking", "preserve_paragraphs", True, None),
    ("chunking", "preserve_tables", True, None),
    ("chunking", "preserve_lists", True, None),
    ("chunking", "preserve_code_blocks", True, None),
    ("chunking", "use_hierarchical", True, None),
    ("chunking", "parent_chunk_size", 2000, (1, None)),
    ("chunking", "child_chunk_size", 500, (1, None)),
    ("hybrid_search", "enabled", True, None),
    ("hybrid_search", "semantic_weight", 0.6, (0, 1)),
    ("hybrid_search", "bm25_weight", 0.4, (0, 1)),
    ("hybrid_search", "use_rrf", True, None),
    ("hybrid_search", "rrf_k", 60, (1, None)),
    ("hybrid_search", "initial_fetch", 30, (1, None)),
    ("hybrid_search", "final_top_k", 5, (1, 100)),
    ("hybrid_search", "min_score", 0.3, (0, 1)),
    ("reranking", "enabled", True, None),
    ("reranking", "model_type", "multilingual", None),
    ("reranking", "custom_model", "", None),
    ("reranking", "top_k_to_rerank", 20, (1, None)),
    ("reranking", "min_score", 0.3, (0, 1)),
    ("reranking", "batch_size", 32, (1, None)),
    ("mmr", "enabled", True, None),
    ("mmr", "lambda_param", 0.7, (0, 1)),
    ("mmr", "diversity_threshold", 0.85, (0, 1)),
    ("query_optimization", "strategy", "auto", ("auto", "hyde", "multi_query", "decomposition", "expansion")),
    ("query_optimization", "hyde_enabled", True, None),
    ("query_optimization", "hyde_max_length", 150, (1, None)),
    ("query_optimization", "multi_query_count", 3, (1, None)),
    ("context", "max_tokens", 15000, (1, None)),
    ("context", "reserved_for_response", 4000, (0, None)),
    ("context", "safety_margin", 0.1, (0, 1)),
    ("context", "compression_enabled", True, None),
    ("context", "target_compression_ratio", 0.5, (0, 1)),
    ("context", "format_style", "numbered", ("numbered", "markdown", "simple")),
    ("context", "include_metadata", True, None),
    ("caching", "enabled", True, None),
    ("caching", "query_cache_ttl_hours", 24, (0, None)),
    ("caching", "query_cache_max_entries", 1000, (1, None)),
    ("caching", "embedding_cache_ttl_days", 30, (0, None)),
    ("caching", "embedding_cache_max_entries", 5000, (1, None)),
    ("caching", "result_cache_ttl_minutes", 60, (0, None)),
    ("caching", "result_cache_max_entries", 500, (1, None)),
    ("source_attribution", "enabled", True, None),
    ("source_attribution", "citation_style", "numeric", None),
    ("source_attribution", "min_confidence_score", 0.4, (0, 1)),
    ("source_attribution", "insert_inline_citations", True, None),
    ("vector_store", "collection_name", "report_docs", None),
    ("vector_store", "parent_collection_name", "report_docs_parents", None),
    ("vector_store", "distance_metric", "cosine", None),
    ("bm25", "k1", 1.5, (0, None)),
    ("bm25", "b", 0.75, (0, 1)),
    ("bm25", "use_stemming", True, None),
    ("bm25", "remove_stopwords", True, None),
    ("bm25", "min_token_length", 2, (1, None)),
]
# Environment variables that override a setting.
ENVIRONMENT = {
    "RAG_EMBEDDING_MODEL": ("embedding", "model"),
    "RAG_EMBEDDING_DEVICE": ("embedding", "device"),
    "RAG_CHUNK_SIZE": ("chunking", "chunk_size"),
    "RAG_CHUNK_STRATEGY": ("chunking", "strategy"),
    "RAG_HYBRID_SEARCH_ENABLED": ("hybrid_search", "enabled"),
    "RAG_SEMANTIC_WEIGHT": ("hybrid_search", "semantic_weight"),
    "RAG_BM25_WEIGHT": ("hybrid_search", "bm25_weight"),
    "RAG_RERANKING_ENABLED": ("reranking", "enabled"),
    "RAG_MAX_TOKENS": ("context", "max_tokens"),
}


def _typed(value, default):
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
    return type(default)(value)


def settings(values: dict | None = None, environment: dict | None = None) -> SimpleNamespace:
    """Settings by section and key from nested values (unknown keys are dropped; `lambda` is lambda_param) and the
    environment, which goes before them."""
    env = os.environ if environment is None else environment
    named = {place: name for name, place in ENVIRONMENT.items()}
    out: dict[str, SimpleNamespace] = {}
    for section, key, default, _ in SETTINGS:
        given = (values or {}).get(section)
        given = given if isinstance(given, dict) else {}
        value = given.get(key, given.get("lambda", default) if key == "lambda_param" else default)
        setattr(out.setdefault(section, SimpleNamespace()), key, _typed(env.get(named.get((section, key), ""), value), default))
    return SimpleNamespace(**out)


def settings_rows(spark: SparkSession, s: SimpleNamespace) -> DataFrame:
    """(section, key, value) of all settings."""
    return spark.createDataFrame([(section, key, str(getattr(getattr(s, section), key))) for section, key, _, _ in SETTINGS], "section string, key string, value string")


def load_settings(path: str) -> SimpleNamespace:
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(yaml.safe_load(f))


def check_settings(s: SimpleNamespace) -> list[str]:
    """What is wrong with settings, if anything."""
    out = []
    for section, key, default, allowed in SETTINGS:
        value = getattr(getattr(s, section), key)
        if allowed is None:
            continue
        if isinstance(default, str):
            if value not in allowed:
                out.append(f"{section}.{key} must be one of {', '.join(allowed)}")
        elif (allowed[0] is not None and value < allowed[0]) or (allowed[1] is not None and value > allowed[1]):
            out.append(f"{section}.{key} must be {allowed[0]} or more" if allowed[1] is None else f"{section}.{key} must be {allowed[0]} to {allowed[1]}")
    if s.chunking.chunk_overlap >= s.chunking.chunk_size:
        out.append("chunking.chunk_overlap must be below chunk_size")
    if abs(s.hybrid_search.semantic_weight + s.hybrid_search.bm25_weight - 1) > 0.01:
        out.append("search weights do not add up to 1")
    return out


def budget(s: SimpleNamespace, prompt_tokens: int = 0) -> int:
    """Tokens left for documents."""
    return max(0, int(s.context.max_tokens * (1 - s.context.safety_margin)) - prompt_tokens - s.context.reserved_for_response)


def valid_or_null(c: Column, low=None, high=None) -> Column:
    """A value within bounds, else null."""
    ok = F.lit(True)
    ok = ok if low is None else ok & (c >= low)
    return F.when(ok if high is None else ok & (c <= high), c)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(report_type, ord, section, title, required, level, least_words, most_words) of YAML files, one a report type, whose
    name is that of the file; a file that cannot be read gives no rows."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for file, text in zip(batch["path"], batch["value"], strict=True):
                try:
                    found = (yaml.safe_load(text) or {}).get("sections", [])
                except (yaml.YAMLError, AttributeError):
                    continue
                kind = file.rpartition("/")[2].removesuffix(".yaml")
                rows += [(kind, i, s.get("id"), s.get("title"), bool(s.get("required", False)), int(s.get("level", 1)), s.get("min_words"), s.get("max_words")) for i, s in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["report_type", "ord", "section", "title", "required", "level", "least_words", "most_words"]).astype({"least_words": "Int64", "most_words": "Int64"})

    files = spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(parse, "report_type string, ord int, section string, title string, required boolean, level int, least_words int, most_words int")


def rules_summary(limits: DataFrame, most: int = 10) -> DataFrame:
    """One text of the limits that `thresholds` gives."""
    listed = lambda c: F.array_join(F.transform(F.slice(c, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
    stated = [F.concat(F.lit(f"- {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("-"))) for name in ("min_words", "min_paragraphs", "min_sources", "min_quality")]
    return limits.select(F.concat_ws("\n", *stated, listed("domains"), listed("forbidden")).alias("text"))
