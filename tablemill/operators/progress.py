"""Work that can be watched and stopped: named steps under a job tag.

An operation runs in a thread of its own. All jobs that it starts carry its tag, so that another thread can ask
how far they are and cancel them. Steps write their tables to the shared folder; a stopped or failed
operation removes every folder that it has begun, once none of its tasks runs any more.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tablemill.frame import PreparedFrame
from tablemill.functions.storage import delete_folder, materialize, recorded

T = TypeVar("T")
#: Seconds between two cancellations of what a stopped operation still starts, and most seconds to wait for its tasks.
AGAIN_S, TASKS_S = 0.2, 30.0


class Cancelled(RuntimeError):
    """The operation was stopped."""


@dataclass(frozen=True)
class Progress:
    phase: str
    steps_done: int
    #: As far as is known: steps that the work has announced or begun.
    steps: int
    #: Tasks of the jobs of this operation so far.
    tasks_done: int
    tasks: int


class Operation:
    """One piece of work. listener is called with the progress after each step, in the order of the steps."""

    def __init__(self, spark: SparkSession, listener: Callable[[Progress], None] | None = None):
        self.spark, self.listener = spark, listener
        self.tag = f"tablemill-{uuid.uuid4().hex}"
        self.phase, self.steps_done, self.steps = "", 0, 0
        self.folders: list[str] = []
        self.result: Future = Future()
        self._stopped = threading.Event()

    def start(self, work: Callable[[Operation], T]) -> Operation:
        """Runs work in the background; `wait` has its result."""
        InheritableThread(target=self._run, args=(work,), daemon=True, session=self.spark).start()
        return self

    def wait(self, seconds: float | None = None) -> object:
        """The work's result; raises what it raised, and Cancelled if it was stopped."""
        return self.result.result(seconds)

    def cancel(self) -> None:
        """Stops the work: its running jobs now, later ones as they come. Returns at once."""
        if not self._stopped.is_set() and not self.result.done():
            self._stopped.set()
            threading.Thread(target=self._keep_stopping, daemon=True).start()

    @property
    def cancelled(self) -> bool:
        return self._stopped.is_set()

    def check(self) -> None:
        """Raises Cancelled if the operation was stopped; for loops of the work."""
        if self._stopped.is_set():
            raise Cancelled(self.phase)

    def expect(self, steps: int) -> None:
        """Announces further steps."""
        self.steps = max(self.steps, self.steps_done + steps)

    def step(self, phase: str, work: Callable[[], T]) -> T:
        self.check()
        self.phase, self.steps = phase, max(self.steps, self.steps_done + 1)
        out = work()
        self.check()
        self.steps_done += 1
        if self.listener:
            self.listener(self.progress())
        return out

    def written(self, phase: str, df: DataFrame) -> DataFrame:
        """A step that writes df to the shared folder; the table."""
        return self.step(phase, lambda: materialize(df, phase))

    def written_frame(self, phase: str, frame: PreparedFrame) -> PreparedFrame:
        """A step that writes a frame, for instance what commands have made of one."""
        return frame.with_df(self.written(phase, frame.df))

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext.statusTracker()
        done = tasks = 0
        for stage in self._stages():
            info = tracker.getStageInfo(stage)
            if info is not None:
                done, tasks = done + info.numCompletedTasks, tasks + info.numTasks
        return Progress(self.phase, self.steps_done, self.steps, done, tasks)

    def _stages(self) -> set[int]:
        context = self.spark.sparkContext
        jobs = map(context.statusTracker().getJobInfo, context._jsc.sc().statusTracker().getJobIdsForTag(self.tag))
        return {s for job in jobs if job is not None for s in job.stageIds}

    def _keep_stopping(self) -> None:
        while not self.result.done():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            time.sleep(AGAIN_S)

    def _run(self, work: Callable[[Operation], T]) -> None:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            with recorded(self.folders):
                out = work(self)
            self.check()
            self.result.set_result(out)
        except BaseException as error:  # noqa: BLE001 - whoever waits has to see it
            self._clear()
            self.result.set_exception(Cancelled(self.phase) if self._stopped.is_set() else error)
        finally:
            context.removeJobTag(self.tag)

    def _clear(self) -> None:
        """Removes the folders, once no task of the operation can write to them."""
        tracker, until = self.spark.sparkContext.statusTracker(), time.monotonic() + TASKS_S
        running = lambda s: (info := tracker.getStageInfo(s)) is not None and info.numActiveTasks > 0
        while time.monotonic() < until and any(map(running, self._stages())):
            time.sleep(AGAIN_S / 2)
        for path in self.folders:
            delete_folder(self.spark, path)
