"""Progress of streams and backlog of staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from keyloft.operators.chunking import backlog


class Progress(StreamingQueryListener):
    """Keeps the last progress of each query: rows in, rows a second, batch id."""

    def __init__(self):
        self.latest: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.latest[str(event.id)] = {"rows": 0, "rate": 0.0, "batch": -1}

    def onQueryProgress(self, event):
        p = event.progress
        held = self.latest.setdefault(str(p.id), {"rows": 0})
        self.latest[str(p.id)] = {"rows": held["rows"] + p.numInputRows, "rate": p.processedRowsPerSecond, "batch": p.batchId}

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def snapshot(staged: DataFrame, progress: Progress | None = None) -> dict:
    """Waiting subsets, payloads and rows, rows that a writer works on, and the streams' last progress."""
    waiting = backlog(staged).agg({"*": "count", "rows": "sum", "payloads": "sum"}).first()
    claimed = staged.filter("claimed_by is not null").agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return {"subsets": waiting["count(1)"], "rows": waiting["sum(rows)"] or 0, "payloads": waiting["sum(payloads)"] or 0, "claimed_rows": claimed, "streams": dict(progress.latest) if progress else {}}


def merge_rate(commits: list[dict]) -> float:
    """Batches merged a second between the first and the last merge of a commit log; 0 for fewer than two merges."""
    merges = [(c["at"], c["note"]["batches"]) for c in commits if c["note"].get("op") == "merge"]
    return sum(n for _, n in merges[1:]) * 1e6 / max(1, merges[-1][0] - merges[0][0]) if len(merges) > 1 else 0.0
