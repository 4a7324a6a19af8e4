"""Near copies: texts whose sets of five-word shingles are alike to four fifths or more, or whose SimHash prints are near.

Sets are linked as in odd_sketch.py, by a rule of its own.  Every pair of sets that
share a band and are not joined yet is looked at, in groups of any size: no band has
a number of partners beyond which others are left out.  A pair of similarity 0.8
shares none of the 38 bands of 5 with probability (1 - 0.8**5)**38, less than 3 in
ten million, and is dropped by its sketches, at an estimate of five standard
deviations under 0.8, with about as small a one.  What is left is compared on the
full sets of words.

SimHash links (simhash.py) are kept beside these.  Copies of a set or of a print are
one node before anything is compared.  Defined results are those of simhash.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import odd_sketch, simhash
from geoframe.llm._shared import checkpointed, drop_unused_shuffles, id_filter, perhaps, renamed
from geoframe.llm.odd_sketch import shingles as shingles

NEAR = odd_sketch.Rule(percent=80, bands=38, rows=5, least=0.60)


def _fingerprints(texts: list[bytes]):  # noqa: ANN202
    return simhash._fingerprints(texts, simhash.SHINGLE_WORDS)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the least id."""
    found, near = odd_sketch.similar_sets(docs, id_col, text_col, NEAR, _fingerprints)
    set_ = F.coalesce("nid", F.lit(-1)).alias("node")  # texts without words have no set, and meet by their print alone
    nodes = checkpointed(found.groupBy(set_, "fp").agg(F.min("id").alias("least")))
    prints = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    drop_unused_shuffles(docs.sparkSession)
    same = nodes.join(prints, "fp").filter("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    close = simhash.links(prints.select("fp")).toDF("x", "y")
    close = close.join(prints.toDF("x", "a"), "x").join(prints.toDF("y", "b"), "y").select("a", "b")
    labels = simhash.components(near.unionByName(same).unionByName(close))
    drop_unused_shuffles(docs.sparkSession)
    named = nodes.select("node", "least").join(labels, "node", "left").select("least", F.coalesce("label", "node").alias("label"))
    winners = named.groupBy("label").agg(F.min("least").alias("id")).select("id").distinct()
    own, (at,) = renamed(docs, id_col)
    ids = own.select(F.col(at).cast("long").alias("own")).distinct()
    losers = checkpointed(ids.join(winners, F.col("own").eqNullSafe(F.col("id")), "left_anti").select(F.col("own").alias("id")))
    bloom = id_filter(losers)
    doubtful = perhaps(own, at, bloom).join(losers, F.col(at).eqNullSafe(F.col("id")), "left_anti")
    return perhaps(own, at, bloom, "left_anti").unionByName(doubtful).toDF(*docs.columns)
