"""Progress of a running scan as a stream of events."""

import json
import threading

from pyspark.sql.streaming import StreamingQueryListener

ENDED = ("done", "error")


class Progress:
    """The latest state of a scan; readers wait for changes of its sequence number."""

    def __init__(self):
        self.changed = threading.Condition()
        self.seq, self.state = 0, {"status": "scanning", "label": "", "done": 0, "total": 0}

    def __call__(self, label, done, total):
        """A progress callback."""
        self._set(label=label, done=done, total=total)

    def finish(self, error=None):
        self._set(status="error" if error else "done", **({"error": str(error)} if error else {}))

    def _set(self, **change):
        with self.changed:
            self.state = self.state | change
            self.seq += 1
            self.changed.notify_all()

    def events(self, timeout=None):
        """Server-sent events: one for the present state and one for each change seen, up to
        and with the one that ends the scan.  Ends early if nothing changes for `timeout`
        seconds."""
        seen = -1
        while True:
            with self.changed:
                if not self.changed.wait_for(lambda: self.seq != seen, timeout):
                    return
                seen, state = self.seq, self.state
            yield f"data: {json.dumps(state)}\n\n"
            if state["status"] in ENDED:
                return


class QueryProgress(StreamingQueryListener):
    """Reports a streaming scan's rows to a Progress as its batches finish."""

    def __init__(self, progress: Progress, label="Hashing", total=0):
        self.progress, self.label, self.total, self.done = progress, label, total, 0

    def onQueryStarted(self, event):
        self.progress(self.label, 0, self.total)

    def onQueryProgress(self, event):
        self.done += event.progress.numInputRows
        self.progress(self.label, self.done, max(self.total, self.done))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.progress.finish(event.exception)
