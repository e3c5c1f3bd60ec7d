"""Answers that outlive a job, and calls that are in flight together."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "payload_json string, model_used string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, stop_reason string, response_time_s double, attempts string"


class TokenBucket:
    """A budget of tokens that fills at a rate, shared by a task's calls. A rate of 0 is none: nothing waits."""

    def __init__(self, per_second: float, most: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.most = per_second, most if most is not None else max(per_second, 1.0)
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.free_at = clock()  # when the bucket would be full again but for what is taken, less its size

    def take(self, tokens: float) -> None:
        """Wait until so many tokens are there. Whoever asks first is served first; more than a bucket holds waits for its share of time."""
        if self.rate <= 0:
            return
        with self.lock:
            now = self.clock()
            self.free_at = max(self.free_at, now - self.most / self.rate) + tokens / self.rate
            wait = self.free_at - now
        if wait > 0:
            self.sleep(wait)


def in_order(work: Callable[[dict], dict], rows: Iterable[dict], width: int) -> Iterator[dict]:
    """What ``work`` makes of each row, in their order, with at most ``width`` of them in flight or waiting to be handed on."""
    if width <= 1:
        yield from map(work, rows)
        return
    waiting: deque[Future] = deque()
    with ThreadPoolExecutor(width) as pool:
        for row in rows:
            if len(waiting) >= width:
                yield waiting.popleft().result()
            waiting.append(pool.submit(work, row))
        while waiting:
            yield waiting.popleft().result()


def call_key(prompt: Column, model: Column, blocks: Column) -> Column:
    """The name of an answer: all that the provider is told, and who is asked."""
    return F.sha2(F.concat_ws("\x00", prompt, model, F.to_json(blocks)), 256)


@dataclass(frozen=True)
class CallStore:
    """Answers by the content that they answer, below a folder that all executors share.

    A task writes each answer aside and moves it into place when it has it, so an answer counts as soon as it is
    there: a job that is killed and started again, a task that is retried, and another job over the same texts
    find it and don't call again. Failed calls are not kept. ``root`` is a URI that pyarrow's file systems know, or a path.
    """

    root: str

    @property
    def _uri(self) -> str:
        return "file://" + self.root[5:] if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root

    def _at(self, key: str):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self._uri)
        return files, f"{base}/answers/{key[:2]}", f"{base}/answers/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        """An answer that is there already."""
        from pyarrow import fs

        files, _, path = self._at(key)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            found = json.loads(f.read())
        found.pop("key")
        return found

    def put(self, key: str, answer: dict) -> None:
        """Keep an answer; of two for the same key either may stay."""
        files, folder, path = self._at(key)
        files.create_dir(folder, recursive=True)
        aside = f"{folder}/.{key}-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as f:
            f.write(json.dumps({"key": key} | answer, ensure_ascii=False).encode())
        files.move(aside, path)

    def answers(self, spark: SparkSession) -> DataFrame:
        """All answers: key and the columns of a call. A row a key."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/answers")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        return spark.read.schema(f"key string, {ANSWER}").option("recursiveFileLookup", True).json(f"{self.root}/answers")
