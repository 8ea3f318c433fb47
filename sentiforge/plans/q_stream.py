"""Streaming: running word counts over documents landed as JSON-lines files."""

from __future__ import annotations

from sentiforge.plans.q_stats import _TOKENS_SQL
from sentiforge.plans.registry import register
from sentiforge.scratch import scratch_path
from sentiforge.sources.tables import table
from sentiforge.streaming.word_count import current_counts, run_word_counts


@register("stream_word_count", f"WITH {_TOKENS_SQL}\nSELECT token, n FROM freq")
def stream_word_count(spark, sf):
    """Documents are landed as JSON-lines files in the shared checkpoint folder and
    followed by a stateful stream; the final counts equal the batch word frequencies."""
    root = scratch_path(spark, "stream")
    table(spark, sf, "documents").select("text").write.json(f"{root}/in")
    run_word_counts(spark, f"{root}/in", f"{root}/out", f"{root}/state")
    return current_counts(spark, f"{root}/out")
