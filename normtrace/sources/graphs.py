"""Process-graph documents whose sections may hold anything, kept as VARIANT.

Nodes and links of all sections come out in one form each. An item that is no object, or lacks a field, has
nulls there and its whole content as JSON in ``item``. A document that is no JSON, or has a section that is no
list, gives no rows of it. ``file_index`` names a document; those that share one, null included, share nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sections of a process graph.
NODE_SECTIONS = ("step_nodes", "data_nodes", "text_nodes")
LINK_SECTIONS = ("SequenceFlow", "MessageFlow", "Association")


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``file_index, doc``: one indented document per file, or one per line for big corpora."""
    doc = F.try_parse_json("value")
    texts = spark.read.text(path, wholetext=multi_line)
    return texts.select(F.try_variant_get(doc, "$.file_index", "bigint").alias("file_index"), doc.alias("doc"))


def _items(docs: DataFrame, sections: tuple[str, ...], pos: str, **fields: str) -> DataFrame:
    """Every item of the sections, with the named fields as strings."""
    every = F.array(*[F.struct(F.lit(s).alias("section"), F.try_variant_get("doc", f"$.{s}", "array<variant>").alias("items")) for s in sections])
    return (
        docs.select("file_index", F.inline(every)).select("file_index", "section", F.posexplode("items").alias(pos, "_item"))
        .select("file_index", "section", pos, *[F.try_variant_get("_item", f"$.{f}", "string").alias(name) for name, f in fields.items()],
                F.to_json("_item").alias("item")))


def nodes(docs: DataFrame) -> DataFrame:
    """``file_index, section, node_pos, resource_id, node_text, agent, type, item``."""
    return _items(docs, NODE_SECTIONS, "node_pos", resource_id="resourceId", node_text="NodeText", agent="agent", type="type")


def links(docs: DataFrame) -> DataFrame:
    """``file_index, section, link_pos, src, tgt, condition, item``."""
    return _items(docs, LINK_SECTIONS, "link_pos", src="src", tgt="tgt", condition="condition")


def dangling_ends(docs: DataFrame) -> DataFrame:
    """``file_index, section, link_pos, side, end``: ends of links that no node of the document answers to.

    One anti join on (document, id); a missing end dangles too.
    """
    ends = links(docs).select("file_index", "section", "link_pos", F.inline(F.array(
        *[F.struct(F.lit(side).alias("side"), F.col(side).alias("end")) for side in ("src", "tgt")])))
    known = nodes(docs).where("resource_id IS NOT NULL").select(F.col("file_index").alias("_file"), F.col("resource_id").alias("_id"))
    return ends.join(known, F.col("file_index").eqNullSafe(F.col("_file")) & (F.col("end") == F.col("_id")), "left_anti")
