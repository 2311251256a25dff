"""Glossary terms in texts: one pass of an automaton over each text, whatever the number of terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T

#: Terms of one automaton, which is sent to all tasks; more terms go through the texts in further automata, in the same stage.
BLOCK_TERMS = 100_000
TERM = "struct<source_term:string,target_term:string,both:boolean>"
TERM_TYPE = pa.struct([("source_term", pa.string()), ("target_term", pa.string()), ("both", pa.bool_())])


def terms_of(glossary: DataFrame) -> DataFrame:
    """``project_id`` (null: all projects), ``low``, ``source_term``, ``target_term``, ``both``: a term counts once in each project, with the first target by alphabet. Empty and null terms are left out."""
    found = glossary.groupBy("project_id", T.strip("source_term").alias("source_term")).agg(F.min(F.struct("target_term", "include_parenthesis_english")).alias("t"))
    return found.where("source_term <> ''").select("project_id", F.lower("source_term").alias("low"), "source_term", F.col("t.target_term").alias("target_term"), F.col("t.include_parenthesis_english").alias("both"))


def blocks(terms: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The terms in lists of about ``size``, one at a time."""
    count = max(1, -(-terms.count() // size))
    for k in range(count):
        part = terms if count == 1 else terms.where(F.pmod(F.xxhash64("source_term"), F.lit(count)) == k)
        yield [tuple(r) for r in part.collect()]


def with_terms(df: DataFrame, text: str, glossary: DataFrame, project: str | None = None, name: str = "terms", size: int = BLOCK_TERMS) -> DataFrame:
    """``df`` with the terms that occur anywhere in a text, ignoring case, sorted: an array ``name`` of (source_term, target_term, both).

    Terms of all projects and of the row's own ``project`` count (without
    ``project`` only those of all projects); of one term in both the project's own.
    Null texts and texts without a term give an empty array. No row is joined or
    shuffled, each text is read once per automaton.
    """
    for part in blocks(terms_of(glossary) if project else terms_of(glossary).where("project_id is null"), size):
        df = _searched(df, text, project, name, part)
    return df


def _searched(df: DataFrame, text: str, project: str | None, name: str, terms: list[tuple]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(terms)
    kept = [c for c in df.columns if c != name]
    earlier = F.col(name) if name in df.columns else F.array().cast(f"array<{TERM}>")
    given = df.select(*kept, earlier.alias(name), F.lower(F.col(text)).alias("_low"), (F.col(project) if project else F.lit(None).cast("string")).alias("_project"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, held = ahocorasick.Automaton(), {}
        for owner, low, *term in shared.value:
            held.setdefault(low, []).append((owner, *term))
        for low, entries in held.items():
            automaton.add_word(low, entries)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for before, low, own in zip(*(c.to_pylist() for c in batch.columns[len(kept) :]), strict=True):
                here = {t["source_term"]: (False, t) for t in before}
                for _, entries in automaton.iter(low) if low and held else ():
                    for owner, source, target, both in entries:
                        if owner is None and source in here or owner is not None and owner != own:
                            continue
                        here[source] = (owner is not None, {"source_term": source, "target_term": target, "both": both})
                found.append([here[s][1] for s in sorted(here)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, type=pa.list_(TERM_TYPE))], names=[*kept, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[: len(kept)])
    return given.mapInArrow(run, f"{fields}, `{name}` array<{TERM}>")


def hits(lines: DataFrame, glossary: DataFrame, size: int = BLOCK_TERMS) -> DataFrame:
    """``key``, ``term``: the terms, of whatever project, that occur anywhere in a line (``key``, ``line``), ignoring case. Null lines hold no term."""
    anywhere = glossary.select(F.lit(None).cast("string").alias("project_id"), "source_term", "target_term", "include_parenthesis_english")
    found = with_terms(lines.select("key", "line"), "line", anywhere, size=size)
    return found.select("key", F.explode(F.col("terms.source_term")).alias("term"))
