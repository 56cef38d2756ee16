"""Scores of hypotheses against references: per pair, then summed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.align import align
from ..functions.tokens import canonical_tokens

KINDS = ("fillers", "fragments", "repetitions", "small_forms")
_LEXICAL = re.compile(r"[a-z0-9]+(?:['’][a-z0-9]+)*(?:-[a-z0-9]+(?:['’][a-z0-9]+)*)*-?")


def kinds_of(fillers: Sequence[str]):
    """The four events as functions of (tokens, index)."""
    f, s = frozenset(fillers), frozenset(L.SMALL_FORMS)
    return (lambda t, i: t[i] in f, lambda t, i: t[i].endswith("-"), lambda t, i: i > 0 and t[i] == t[i - 1], lambda t, i: t[i] in s)


def lexical_tokens(text: str | None) -> list[str]:
    return _LEXICAL.findall(unicodedata.normalize("NFKC", text or "").lower().replace("’", "'"))


def character_tokens(tokens: list[str]) -> list[str]:
    """Characters of verbatim tokens; an unclear mark stays one unit."""
    return [c for t in tokens for c in ([t] if t == L.UNCLEAR else t)]


_WORDS = ("units", "subs", "dels", "ins")
_EVENTS = [f"{k}_{c}" for k in KINDS for c in ("ref", "hyp", "tp")]
LEXICAL_COLUMNS = [*(f"lexical_{c}" for c in _WORDS), *_EVENTS]


def _events(pairs, kinds) -> np.ndarray:
    return np.array([[sum(f(t, i) for i in range(len(t))) for f in kinds for t in p] for p in pairs], dtype=np.int64).reshape(len(pairs), -1, 2)


PARTS = ("verbatim", "conventional", "cer", "events")


def columns_of(parts: Sequence[str]) -> list[str]:
    return [*(f"{p}_{c}" for p in PARTS[:3] if p in parts for c in _WORDS), "unclear", *(_EVENTS if "events" in parts else ())]


def score_pairs(pairs: list[tuple[str | None, str | None]], parts: Sequence[str] = PARTS, table: str | None = None) -> pd.DataFrame:
    """The counts of the canonical scorer that ``parts`` name, for (reference, hypothesis) pairs; null counts as empty.

    The character columns are null where the reference holds unclear words.
    """
    tokens = [(canonical_tokens(r, table=table), canonical_tokens(h, table=table)) for r, h in pairs]
    unclear = np.array([r.count(L.UNCLEAR) for r, _ in tokens], dtype=np.int64)
    out = {"unclear": unclear}
    if "verbatim" in parts or "events" in parts:
        kinds = kinds_of(L.FILLERS) if "events" in parts else ()
        counts = align(tokens, kinds)
        out |= {"verbatim_units": [sum(t != L.UNCLEAR for t in r) for r, _ in tokens]} | {f"verbatim_{c}": counts[:, k] for k, c in enumerate(_WORDS[1:])}
        if kinds:
            found = _events(tokens, kinds)
            for k, name in enumerate(KINDS):
                out |= {f"{name}_ref": found[:, k, 0], f"{name}_hyp": found[:, k, 1], f"{name}_tp": counts[:, 3 + k]}
    if "conventional" in parts:
        plain = [(canonical_tokens(r, True, table), canonical_tokens(h, True, table)) for r, h in pairs]
        counts = align(plain)
        out |= {"conventional_units": [sum(t != L.UNCLEAR for t in r) for r, _ in plain]} | {f"conventional_{c}": counts[:, k] for k, c in enumerate(_WORDS[1:])}
    if "cer" in parts:
        chars = [(character_tokens(r), character_tokens(h)) if not u else ([], []) for (r, h), u in zip(tokens, unclear, strict=True)]
        cer = np.column_stack([[len(r) for r, _ in chars], align(chars)]) if chars else np.zeros((0, 4))
        for k, c in enumerate(_WORDS):
            out[f"cer_{c}"] = pd.array(cer[:, k].astype(np.int64), dtype="Int64")
            out[f"cer_{c}"][unclear > 0] = pd.NA
    return pd.DataFrame(out)[columns_of(parts)]


def score_lexical(pairs: list[tuple[str | None, str | None]]) -> pd.DataFrame:
    """Counts of the lexical scorer: ASCII tokens, plain alignment, the wider fillers."""
    kinds = kinds_of(L.FILLERS_WIDE)
    tokens = [(lexical_tokens(r), lexical_tokens(h)) for r, h in pairs]
    counts, found = align(tokens, kinds, masked=False), _events(tokens, kinds)
    out = {"lexical_units": [len(r) for r, _ in tokens]} | {f"lexical_{c}": counts[:, k] for k, c in enumerate(_WORDS[1:])}
    for k, name in enumerate(KINDS):
        out |= {f"{name}_ref": found[:, k, 0], f"{name}_hyp": found[:, k, 1], f"{name}_tp": counts[:, 3 + k]}
    return pd.DataFrame(out)[LEXICAL_COLUMNS]


def scored(predictions: DataFrame, keys: Sequence[str], reference: str = "reference", hypothesis: str = "hypothesis", lexical: bool = False, parts: Sequence[str] = PARTS, table: str | None = None) -> DataFrame:
    """The keys with one column for each count of the named parts; rows with a null reference are left out, a null hypothesis is empty."""
    columns = LEXICAL_COLUMNS if lexical else columns_of(parts)
    base = predictions.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{reference}`").alias("_r"), F.col(f"`{hypothesis}`").alias("_h")).where("_r IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [*zip(b["_r"], b["_h"], strict=True)]
            s = score_lexical(pairs) if lexical else score_pairs(pairs, parts, table)
            yield pd.concat([b[list(keys)].reset_index(drop=True), s], axis=1)

    kinds = dict(base.dtypes)
    return base.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} long" for c in columns)]))


def rate(errors: Column, units: Column) -> Column:
    return errors / F.greatest(units, F.lit(1))


def micro(scores: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    """Summed units and errors of one comparison by group, and their rate; rows without it (null) don't count."""
    s = lambda c: F.coalesce(F.sum(f"{prefix}_{c}"), F.lit(0)).alias(c)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("examples"), *[s(c) for c in _WORDS]).withColumn("error_rate", rate(F.col("subs") + F.col("dels") + F.col("ins"), F.col("units")))


def macro(scores: DataFrame, by: Sequence[str], over: str, prefix: str) -> DataFrame:
    """Unweighted mean of the groups' rates over ``over``."""
    return micro(scores, [*by, over], prefix).groupBy(*by).agg(F.avg("error_rate").alias("macro_rate"), F.count(F.lit(1)).alias("n_groups"))


def event_rates(scores: DataFrame, by: Sequence[str], nullable: bool = True) -> DataFrame:
    """Precision, recall and F1 of each kind of event by group.

    With ``nullable``, all three are null where neither side has the event; else they are 0.
    """
    sums = scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _EVENTS])
    long = sums.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_ref").alias("reference"), F.col(f"{k}_hyp").alias("hypothesis"), F.col(f"{k}_tp").alias("true_positive")) for k in KINDS])).alias("x")).select(*by, "x.*")
    return prf(long, nullable)


def prf(counts: DataFrame, nullable: bool = True) -> DataFrame:
    """Adds precision, recall and f1 to reference, hypothesis and true_positive."""
    none = (F.col("reference") + F.col("hypothesis") == 0) if nullable else F.lit(False)
    share = lambda n: F.when(none, None).when(F.col(n) == 0, 0.0).otherwise(F.col("true_positive") / F.col(n))
    p = counts.withColumns({"precision": share("hypothesis"), "recall": share("reference")})
    return p.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def report(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """One wide row per group: examples, masked units, and the rate of each comparison."""
    e = lambda p: (F.sum(f"{p}_subs") + F.sum(f"{p}_dels") + F.sum(f"{p}_ins"), F.sum(f"{p}_units"))
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("examples"),
        F.count(F.when(F.col("unclear") > 0, 1)).alias("examples_with_unclear"),
        F.sum("unclear").alias("unclear_units"),
        *[F.coalesce(rate(*e(p)), F.lit(0.0)).alias(f"{p}_rate") for p in ("verbatim", "conventional", "cer")],
    )
