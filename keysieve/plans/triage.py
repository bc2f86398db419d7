"""From files to analysed candidates and ranked findings, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.lineage import stored
from keysieve.functions.paths import raw_url
from keysieve.operators.context import add_context
from keysieve.operators.features import add_features
from keysieve.operators.heuristic import Scorer, baseline_scorer
from keysieve.operators.recover import SEGMENT_CHARS, first_wins, recover_candidates
from keysieve.operators.report import build_findings, rank_findings
from keysieve.operators.search import attach_content, newest_per_pattern, numbered, pattern_hits, scan_hits


def analyze(
    files: DataFrame,
    scorer: Scorer | None = None,
    signatures: Sequence[C.Signature] = C.SIGNATURES,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Every distinct candidate with context, features and decision.

    Recovery, context and features need nothing but the file's own row, so all
    of them run in the scan's stage. The only exchange drops duplicates and
    carries finished rows: a later sort or a second use reads them back instead
    of deriving them again.
    """
    found = recover_candidates(files, signatures, segment_chars)
    rows = first_wins(add_features(add_context(found)))
    return (scorer or baseline_scorer())(rows)


def find(files: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Approved findings, highest risk first."""
    return rank_findings(build_findings(analyze(files, scorer)))


def search(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """All raw hits of every pattern; ``hit_ord`` puts patterns in turn, newest files first."""
    return scan_hits(numbered(pattern_hits(files, patterns)))


def search_newest(files: DataFrame, patterns: DataFrame, pages: int = 1) -> DataFrame:
    """Raw hits of every pattern up to ``pages`` of the newest, as a paging service shows them."""
    return scan_hits(newest_per_pattern(pattern_hits(files, patterns), pages))


def scan(
    files: DataFrame, patterns: DataFrame, scorer: Scorer | None = None, contents: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """All raw hits, found once and kept in the shared folder, and the analyses of the files they name.

    ``contents`` (raw_url, content) are the texts behind the hits' addresses, the files'
    own by default. Those of ``land_by_address`` are read where they lie; for others
    Spark decides by the size of the stored hits whether the hits go to the texts.
    """
    hits = stored(search(files, patterns))
    texts = files.select(raw_url(F.col("url")).alias("raw_url"), "content") if contents is None else contents
    return hits, analyze(attach_content(hits, texts, once_per_file=True), scorer)
