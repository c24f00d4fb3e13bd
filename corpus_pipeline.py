"""A corpus from raw documents: quality, near-duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
Stages but the last return the columns of ``docs``, whatever their names; an empty
table gives an empty result, and texts of any length are read whole.
"""

from __future__ import annotations

from strandloom.llm.common import Scratch, table
from strandloom.llm.decontamination import decontaminated
from strandloom.llm.jaccard import deduplicated
from strandloom.llm.mixing import mixed
from strandloom.llm.quality import accepted
from strandloom.llm.sharding import shard


def quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go.

    Null and empty texts are judged by the classifier's offset. Those at the threshold
    stay. Repeated rows go or stay together. If a class has no labelled rows, all stay.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked at 5-word Jaccard 0.8 the one with the smallest doc_id stays.

    Null and empty texts are linked with nothing and stay, and so do rows without
    doc_id. Of rows with equal doc_id and text one stays.
    """
    return deduplicated(docs, gram=5, percent=80)


def leaks(spark, docs, sf_dir):
    """Documents that overlap a benchmark item go, as a whole.

    12 equal words of a stretch where 80% are equal, of short items 80%, make an overlap. Null
    and empty texts and items have none. Repeated rows go or stay together.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Documents as often as the mix takes them.

    Null and empty texts have size 0; a null source is one of its own. Of equal sizes a
    digest of the id decides; repeated rows are taken one by one.
    """
    return mixed(docs)


def shards(spark, docs, sf_dir):
    """Shard and slot of every document of the mix; copies of one text are kept together.

    A null text has size 1 and no copies; null ids and repeated rows each get a slot. Ties
    go by hashes of the text.
    """
    return shard(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", leaks), ("mixing", mix), ("sharding", shards)]

#: The fitted classifier and the iterative stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES applied in turn to documents, each stage's rows written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            scratch.drop(before)
    return docs
