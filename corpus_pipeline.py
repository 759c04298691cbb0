"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, folder) and returns a table. All but the last return the columns of documents;
a stage works on what its predecessor kept.

| stage | what happens |
|---|---|
| toxicity | documents predicted to be toxic go |
| near_duplicates | of each group of similar documents one stays |
| decontamination | documents that share ten words in a row with a benchmark item go |
| pii | personal data become pseudonyms of the same format |
| packing | token sequences: one row per piece with its place |

Edge cases: rows with a null or empty text stay (no words, not toxic, no duplicates but rows that are the same in
id and text, of which one stays) and are packed as one end mark; a null id is an id like any other; ties between
near copies go to the least (doc_id, text); empty tables give empty tables; columns of documents that bear a name
of a stage's own pass through unchanged.

Memory: Spark hands texts to Python in batches counted in rows, and holds a batch outside the heap, several
times over while it grows. A stage sees to it that a batch has at most ``BATCH_ROWS`` rows, if the session allows more;
the setting stays, as what a stage returns is worked out later.
"""

import functools

from basketry.llm import decontamination, jaccard_join, packing, pii, tables, toxicity
from basketry.storage import save

BATCH_ROWS, _BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(stage):
    """The stage, after the session's batches are bounded; 0 or less stands for no bound."""

    @functools.wraps(stage)
    def bounded(spark, docs, folder):
        if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, folder)

    return bounded


@_small_batches
def drop_toxic(spark, docs, folder):
    return toxicity.clean(docs, tables.read(spark, folder, "labels"))


@_small_batches
def drop_near_duplicates(spark, docs, folder):
    return jaccard_join.one_per_group(docs)


@_small_batches
def drop_contaminated(spark, docs, folder):
    return decontamination.clean(docs, tables.read(spark, folder, "benchmark"))


@_small_batches
def replace_personal_data(spark, docs, folder):
    return pii.pseudonymise(docs, pii.TEST_KEY)


@_small_batches
def pack_sequences(spark, docs, folder):
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: A model, bands and a tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a folder; each result is written and read again."""
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
