"""Windows of a fixed number of pages over a stream in which pages come in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A page that is there, or could not be read (error); n_pages: of its document.
PAGES = "doc long, page_idx long, n_pages long, error string"
#: event: `window` with its pages, or `failed` with the first error, after which no window of the document comes.
EVENTS = "doc long, event string, window_id long, first long, last long, error string"


class PageWindows(StatefulProcessor):
    """Per document: which pages of each open window are there, as bits, and whether it failed or which windows are done."""

    def __init__(self, size: int, start: int, end: int):
        self.size, self.start, self.end = size, start, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failed = handle.getValueState("failed", "error string")
        self.pages = handle.getMapState("pages", "window long", "seen binary")
        self.done = handle.getMapState("done", "window long", "at boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.failed.exists():
            return
        out, held = [], {}
        for batch in rows:
            wrong = batch[batch["error"].notna()]
            if len(wrong):
                first = wrong.sort_values("page_idx", kind="stable").iloc[0]
                self.failed.update((first["error"],))
                self.pages.clear()
                self.done.clear()
                yield pd.DataFrame({"doc": [key[0]], "event": ["failed"], "window_id": [None], "first": [None], "last": [None], "error": [first["error"]]})
                return
            for page, total in zip(batch["page_idx"], batch["n_pages"], strict=True):
                page, last = int(page), min(self.end, int(total) - 1)
                if not self.start <= page <= last:
                    continue
                window = (page - self.start) // self.size
                first = self.start + window * self.size
                n = min(self.size, last - first + 1)
                if window not in held:
                    if self.done.containsKey((window,)):
                        continue
                    held[window] = (int.from_bytes(self.pages.getValue((window,))[0], "little") if self.pages.containsKey((window,)) else 0, first, n)
                held[window] = (held[window][0] | 1 << (page - first), first, n)
        for window, (seen, first, n) in sorted(held.items()):
            if seen == (1 << n) - 1:
                out.append((key[0], "window", window, first, first + n - 1, None))
                self.done.updateValue((window,), (True,))
                if self.pages.containsKey((window,)):
                    self.pages.removeKey((window,))
            else:
                self.pages.updateValue((window,), (seen.to_bytes(self.size // 8 + 1, "little"),))
        if out:
            yield pd.DataFrame(out, columns=["doc", "event", "window_id", "first", "last", "error"])

    def close(self) -> None:
        pass


def page_windows(pages: DataFrame, size: int, start: int = 0, end: int = 99_999) -> DataFrame:
    """EVENTS of a stream of PAGES; output mode append, state store RocksDB (see lifecycle.STORE).

    A window comes when its last page is there, whatever their order and
    however often a page comes; the last window of a document has fewer pages.
    The first error of a document cancels its open windows and all later ones.
    """
    return pages.select("doc", "page_idx", "n_pages", "error").groupBy(F.col("doc")).transformWithStateInPandas(PageWindows(size, start, end), EVENTS, "append", "none")
