"""From raw documents to packed training sequences, as five stages over one table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet in the shared checkpoint folder and reads them again, so a
lost executor never repeats an earlier stage. All but the last return the columns of
``documents``. Rows with null or empty texts pass through as the operators define: the
classifier scores them as empty texts, the other stages keep them. An empty table gives
an empty result; extra columns travel along and are dropped by the last stage only.
"""

from __future__ import annotations

import uuid

from riskloom.llm import minhash, mixing, packing, pii, quality_classifier
from riskloom.session import ensure_checkpoint_dir, scratch_path


def good_only(spark, docs, sf_dir):
    """Documents that the ranking model, learned from the labels, does not reject."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def one_of_each(spark, docs, sf_dir):
    """One document of each near-duplicate group."""
    return minhash.keep_one(docs)


def without_personal_data(spark, docs, sf_dir):
    """Personal data replaced by marks."""
    return pii.redact(docs)


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark, docs, sf_dir):
    """Pieces of token sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_classifier", good_only),
    ("minhash_near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Trained models and hashes are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
