"""A corpus made ready for training, in stages; each takes and gives documents.

Null and empty texts go in the first stage, and rows without an id stay as they are; repeated rows count as one from the
second stage on; texts of any length stay whole. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartweave.llm.common import shared_folder
from chartweave.llm.neardup import neardup_stage
from chartweave.llm.packing import packing_stage
from chartweave.llm.passages import passage_stage
from chartweave.llm.pseudonyms import pseudonym_stage
from chartweave.llm.quality import quality_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("near-duplicates", neardup_stage),
    ("repeated passages", passage_stage),
    ("pseudonyms", pseudonym_stage),
    ("packing", packing_stage),
]

#: The learned rules of the first stage, near-duplicate classes and tokens have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again, and goes when the next is written.

    The last result stays, as the rows that are returned are read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{k - 1}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return docs
