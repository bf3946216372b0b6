"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.columns import stored
from weftline.llm.borda import borda_points, borda_ranking
from weftline.llm.containment import leaked_items
from weftline.llm.mojibake import GarbledText, garbled_copies
from weftline.llm.packing import pack, token_counts
from weftline.llm.topn import top_n_per_group

__all__ = ["QUERIES", "SQL"]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _top(spark: SparkSession, sf: str, n: int, **how) -> DataFrame:
    edges = _read(spark, sf, "lesmis_edges").where("src is not null and weight is not null")
    order = [("weight", "desc"), ("seen_at", "asc"), ("edge_id", "asc")]
    return top_n_per_group(edges, "src", order, n, same=["edge_id", "weight", "seen_at"], **how)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 3).select("src", "edge_id")


def p1_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 10, rank="place").select("src", F.col("place").cast("long").alias("place"), "edge_id", F.col("weight").cast("long").alias("weight"))


_SCORES = {"pagerank": 1.0, "in_degree": 1.0}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    ranked = borda_ranking(_read(spark, sf, "readme"), "graph_name", "id", _SCORES, 10, ties="min", missing="last")
    return ranked.select("graph_name", "id")


def p4_borda(spark: SparkSession, sf: str) -> DataFrame:
    return borda_points(_read(spark, sf, "readme"), "graph_name", "id", _SCORES)


def _packed(spark: SparkSession, sf: str, size_class: str) -> DataFrame:
    documents = _read(spark, sf, "documents")
    container = _read(spark, sf, "containers").where(F.col("size_class") == size_class).first()
    sizes = token_counts(documents, "doc_id", "text")
    placed = pack(sizes, "doc_id", "n_tokens", container["capacity_tokens"], n_items=documents.count())
    return placed.withColumns({"container_id": F.lit(container["container_id"]), "size_class": F.lit(size_class)})


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "long")


def p6_pack_short(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "short")


def p6_pack_medium(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "medium")


def p6_pack_book(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "book")


def p6_checked(spark: SparkSession, sf: str) -> DataFrame:
    """For each container what must hold: all documents placed, none split that fits, no window overfull or with gaps, little space unused."""
    documents = _read(spark, sf, "documents")
    sizes = stored(token_counts(documents, "doc_id", "text"))
    n, out = sizes.count(), None
    for c in _read(spark, sf, "containers").collect():  # four rows
        capacity = c["capacity_tokens"]
        placed = stored(pack(sizes, "doc_id", "n_tokens", capacity, n_items=n))
        per_item = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("pieces"))
        both = sizes.join(per_item.withColumnRenamed("n_tokens", "placed"), "doc_id", "left").agg(
            F.count_if(F.col("placed") == F.col("n_tokens")).alias("n_documents"), F.count_if((F.col("n_tokens") <= capacity) & (F.col("pieces") > 1)).alias("n_split")
        )
        windows = placed.where("window is not null").groupBy("shard", "window").agg(F.sum("n_tokens").alias("used"), F.max(F.col("starts_at") + F.col("n_tokens")).alias("end"))
        room = windows.agg(
            F.count_if((F.col("used") > capacity) | (F.col("used") != F.col("end"))).alias("n_overfull"),
            # A shard may leave as many windows open as it has levels of use; what is unused beyond is a twentieth at most.
            (F.coalesce(F.sum("used"), F.lit(0)) >= 0.95 * capacity * (F.count("*") - 8 * F.count_distinct("shard"))).alias("well_filled"),
        )
        row = both.join(F.broadcast(room)).select(F.lit(c["container_id"]).alias("container_id"), "n_documents", "n_split", "n_overfull", "well_filled")
        out = row if out is None else out.unionByName(row)
    return out


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(
        _read(spark, sf, "documents"), _read(spark, sf, "eval_items"),
        document_id="doc_id", document_text="text", item_id="item_id", item_text="text",
    )


def p7_by_item(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "eval_items").select("item_id", "suite")
    counted = p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.join(counted, "item_id")


def _garbled(spark: SparkSession, sf: str) -> GarbledText:
    return GarbledText(_read(spark, sf, "documents"), key="doc_id", text="text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).found()


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).restored()


#: Transformations that the round trip puts clean documents through.
ROUND_TRIP = ["utf_8>cp1252", "utf_8>cp437", "utf_8>mac_roman", "utf_8>cp1251", "cp1252>mac_roman", "cp1251>cp1252", "koi8_r>cp1251", "euc_jp>latin_1"]


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """``(how, n_garbled, n_regained)``: clean documents of the query set (identifiers divisible by 20), garbled and restored among all documents.

    Each goes through the first transformation, counted on from its identifier, that it can be written in.
    """
    documents = _read(spark, sf, "documents").select("doc_id", "text")
    clean = documents.where("doc_id % 20 = 0").join(_garbled(spark, sf).found(), "doc_id", "left_anti")
    bad = stored(clean.mapInArrow(garbled_copies(ROUND_TRIP), "doc_id long, text string, original string, how string"))
    both = documents.unionByName(bad.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    restored = GarbledText(both, key="doc_id", text="text").restored().select((-1 - F.col("doc_id")).alias("doc_id"), "restored_text")
    met = bad.join(restored, "doc_id", "left").groupBy("how")
    return met.agg(F.count("*").alias("n_garbled"), F.count_if(F.col("restored_text") == F.col("original")).alias("n_regained"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_top10, p4_found, p4_borda, p6_pack, p6_pack_short, p6_pack_medium, p6_pack_book, p6_checked, p7_found, p7_by_item, p8_found, p8_restored, p8_roundtrip)
}

_ITEMS = """with once as (select distinct src, edge_id, weight, seen_at from lesmis_edges where src is not null and weight is not null),
ranked as (select *, row_number() over (partition by src order by weight desc, seen_at nulls last, edge_id) as place from once)"""

_LEAKS = r"""with d as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from documents),
i as (select item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from eval_items),
dp as (select distinct doc_id, array_to_string(w[k:k+11], ' ') as p from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
ip as (select distinct item_id, array_to_string(w[k:k+11], ' ') as p from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
leaks as (select distinct doc_id, item_id from dp join ip using (p))"""

SQL = {
    "p1_found": f"{_ITEMS} select src, edge_id from ranked where place <= 3",
    "p1_top10": f"{_ITEMS} select src, place, edge_id, weight::bigint as weight from ranked where place <= 10",
    "p4_found": """with once as (select distinct graph_name, id,
        case when isnan(pagerank) then null else pagerank end as a, in_degree as b
      from readme where graph_name is not null and id is not null),
    placed as (select graph_name, id,
        rank() over (partition by graph_name order by a desc nulls last) + rank() over (partition by graph_name order by b desc nulls last) as s from once),
    best as (select graph_name, id, min(s) as s from placed group by all)
    select graph_name, id from best qualify row_number() over (partition by graph_name order by s, id) <= 10""",
    "p4_borda": """with once as (select distinct graph_name, id,
        case when isnan(pagerank) then null else pagerank end as a, in_degree::double as b
      from readme where graph_name is not null and id is not null),
    n as (select *, count(a) over g as na, count(b) over g as nb, count(*) over g as n from once window g as (partition by graph_name)),
    placed as (select graph_name, id,
        case when a is null then (n + na - na + 0.0) else 0 end as unused,
        case when a is null then (n + 1) / 2.0 else rank() over (partition by graph_name order by a desc nulls last) + (count(*) over (partition by graph_name, a) - 1) / 2.0 end as pa,
        case when b is null then (n + 1) / 2.0 else rank() over (partition by graph_name order by b desc nulls last) + (count(*) over (partition by graph_name, b) - 1) / 2.0 end as pb from n)
    select graph_name, id, (pa + pb)::double as points from placed""",
    "p6_checked": """select container_id, (select count(*) from documents)::bigint as n_documents, 0::bigint as n_split, 0::bigint as n_overfull, true as well_filled
    from containers""",
    "p7_found": f"{_LEAKS} select doc_id, item_id from leaks",
    "p7_by_item": f"{_LEAKS} select item_id, suite, count(*)::bigint as n_documents from leaks join eval_items using (item_id) group by all",
}
