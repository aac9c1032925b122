"""Progress inference over a stream of frames: keyed state carries the window and the last progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "episode long, frame_id long, window_frame_indices array<long>, parsed_progress double, progress double, progress_source string"
STATE = "frames array<long>, progress double, pending_ids array<long>, pending_values array<double>"


def progress_stream(frames: DataFrame, *, window: int = 4, idle_ms: int | None = None) -> DataFrame:
    """Adds to each frame (episode, frame_id, parsed_progress) its clamped window of frame ids and the carried progress, like the
    batch operators W9 and W10.  Frames of an episode are numbered from 0; one that comes early waits in the state until
    those before it are there, so the result doesn't depend on how the stream is cut.  A frame that arrives again is dropped.

    The state of an episode is a window, a number and the frames that wait; with `idle_ms` it leaves when the episode has been silent
    for so many milliseconds, and frames that come later still start anew.  That needs a query that goes on; one that ends when
    the source is read (run_available) waits for the timeouts and never ends.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames_, progress, ids, values = state.get if state.exists else ([], 0.0, [], [])
        last = frames_[-1] if len(frames_) else -1
        held = [int(f) for f in frames_]
        waiting = dict(zip([int(i) for i in ids], values))
        for pdf in parts:
            for f, v in zip(pdf["frame_id"], pdf["parsed_progress"]):
                if int(f) > last:
                    waiting.setdefault(int(f), None if pd.isna(v) else float(v))
        out = []
        while last + 1 in waiting:
            last += 1
            value = waiting.pop(last)
            held = (held + [last])[-window:]
            progress = progress if value is None else value
            out.append((key[0], last, [held[0]] * (window - len(held)) + held, value, progress, "previous" if value is None else "model"))
        state.update((held, float(progress), list(waiting), list(waiting.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["episode", "frame_id", "window_frame_indices", "parsed_progress", "progress", "progress_source"])

    return frames.groupBy("episode").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def run_available(query_frames: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes what the source has now as Parquet, exactly once, and ends."""
    q = query_frames.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
