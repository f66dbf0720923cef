"""The same transformations on streams, windowed rates with late data, and guarded requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recognizers import Rule, detect


def read_rows(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    """A stream over Parquet files of a folder."""
    reader = spark.readStream.schema(schema).format("parquet")
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, field: str = "payload") -> DataFrame:
    """A Kafka topic's JSON messages; those without the field are passed over. Needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select("key", "timestamp", F.get_json_object(F.col("value").cast("string"), f"$.{field}").alias("text")).where("text is not null")


def detect_stream(rows: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    return detect(rows, rules)


def rates(rows: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped and state behind it is freed."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def guard_step(times: list[int], until: int, trial: bool, at: int, seconds: int, most: int, pause: int) -> tuple[str, list[int], int, bool]:
    """What a request at a time meets, and the state behind it.

    At most ``most`` are allowed in ``seconds``. The request that finds them used up trips the guard, which is open for
    ``pause``; the first one after that is a trial: if the span has room again it is allowed and closes the guard, else it
    trips it anew.
    """
    if at < until:
        return "open", times, until, True
    times = [x for x in times if x > at - seconds]
    if len(times) >= most:
        return "tripped", times, at + pause, True
    return ("half_open" if trial else "allowed"), [*times, at], until, False


def guard(rows: DataFrame, key: str, ts: str, order: str, seconds: int = 3600, most: int = 10, pause: int = 900, late: str = "10 minutes") -> DataFrame:
    """(key, at, number, outcome) for each request of a stream: allowed, tripped, open or half_open.

    Requests are judged in order of time once the watermark has passed them, so the outcome does not depend on how they
    were cut into micro-batches; until then they wait in the state. One that comes behind the watermark is dropped, as
    Spark's windows do, and so never allowed: it cannot change what was told. A key's state is freed when the watermark is
    past its last span and pause. ``order``, a whole number, breaks ties in time.
    """
    keep = max(seconds, pause)

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        mark = state.getCurrentWatermarkMs() // 1000
        waiting, times, until, trial = state.get if state.exists else ([], [], 0, False)
        waiting, times, out = [tuple(x) for x in waiting], list(times), []
        if not state.hasTimedOut:
            waiting += [x for p in parts for x in zip(p["at"].tolist(), p["number"].tolist(), strict=True)]
        # What lies before the watermark is whole: nothing earlier can come.
        due = sorted(x for x in waiting if x[0] < mark)
        waiting = sorted(x for x in waiting if x[0] >= mark)
        for at, number in due:
            outcome, times, until, trial = guard_step(times, until, trial, at, seconds, most, pause)
            out.append((str(keys[0]), at, number, outcome))
        last = max([*times, until - pause if until else 0, 0])
        if not waiting and last + keep < mark:
            state.remove()
        else:
            state.update((waiting, times, until, trial))
            wake = min([w[0] for w in waiting], default=last + keep) + 1
            state.setTimeoutTimestamp(max(wake, mark + 1) * 1000)
        yield pd.DataFrame(out, columns=["key", "at", "number", "outcome"])

    own = rows.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.unix_timestamp(F.col(ts)).alias("at"), F.col(order).cast("long").alias("number"), F.col(ts))
    return own.groupBy("key").applyInPandasWithState(step, "key string, at long, number long, outcome string", "waiting array<struct<at:long,number:long>>, times array<long>, until long, trial boolean", "append", "EventTimeTimeout")


def guarded_batch(rows: DataFrame, key: str, at: str, order: str, seconds: int = 3600, most: int = 10, pause: int = 900) -> DataFrame:
    """What ``guard`` tells of a stream without late requests, of a table; a key's requests pass through one task in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, ([], 0, False)
        for part in parts:
            out = []
            for k, t in zip(part["key"], part["at"].tolist(), strict=True):
                if k != now:
                    now, state = k, ([], 0, False)
                outcome, *state = guard_step(*state, t, seconds, most, pause)
                out.append(outcome)
            yield part.assign(outcome=out)

    own = rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.col(order).cast("long").alias("number"))
    return own.repartition("key").sortWithinPartitions("key", "at", "number").mapInPandas(run, "key string, at long, number long, outcome string")


def restore_step(held: str, chunk: str, longest: int, pairs: dict[str, str], pattern) -> tuple[str, str]:  # noqa: ANN001
    """(text told, text held back) behind a chunk: a suffix stays back as long as it may begin a placeholder."""
    text = held + chunk
    out, at = [], 0
    # No placeholder that begins before the last ``longest - 1`` characters can still grow.
    sure = len(text) - (longest - 1)
    while (m := pattern.search(text, at)) and m.start() < sure:
        out += [text[at : m.start()], pairs[m[0]]]
        at = m.end()
    stop = max(at, sure, 0)
    return "".join([*out, text[at:stop]]), text[stop:]


def restored(chunks: DataFrame, pairs: dict[str, str], answer: str = "answer", number: str = "number", text: str = "chunk", last: str = "last", groups: int | None = None) -> DataFrame:
    """(answer, number, text): the chunks of streamed answers with placeholders turned back, wherever the chunks are cut.

    A chunk tells what cannot be part of a placeholder any more; what may be is held in the answer's state and told with a
    later chunk, all of it with the one marked ``last``, which frees the state. Chunks wait for those before them. Where
    placeholders overlap the leftmost counts, of those that begin there the longest; originals are not searched again.

    A key of Spark's state costs milliseconds a micro-batch. Where many answers come at once, ``groups`` deals them by hash
    to so many keys; a key's open answers are then written anew with each micro-batch that brings it a chunk.
    """
    import re

    names = sorted((k for k in pairs if k), key=len, reverse=True)
    longest = max(map(len, names), default=1)
    pattern = re.compile("|".join(map(re.escape, names)) or r"(?!)")

    def step(_: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now = {x[0]: (x[1], x[2], {n: (c, e) for n, c, e in x[3]}) for x in (state.get[0] if state.exists else [])}
        met = set()
        for p in parts:
            for name, n, c, e in zip(p["answer"].tolist(), p["number"].tolist(), p["chunk"].tolist(), p["last"].tolist(), strict=True):
                met.add(name)
                now.setdefault(name, (0, "", {}))[2][int(n)] = (c or "", bool(e))
        out = []
        for name in met:
            due, held, early = now[name]
            over = False
            while due in early and not over:
                chunk, over = early.pop(due)
                told, held = restore_step(held, chunk, longest, pairs, pattern)
                if over:
                    told, held = told + pattern.sub(lambda m: pairs[m[0]], held), ""
                out.append((name, due, told))
                due += 1
            if over:
                del now[name]
            else:
                now[name] = (due, held, early)
        if now:
            state.update(([(name, due, held, [(n, c, e) for n, (c, e) in early.items()]) for name, (due, held, early) in now.items()],))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["answer", "number", "text"])

    own = chunks.select(F.col(answer).cast("string").alias("answer"), F.col(number).cast("long").alias("number"), F.col(text).alias("chunk"), F.col(last).alias("last"))
    key = F.col("answer") if groups is None else F.pmod(F.xxhash64("answer"), F.lit(groups))
    open_ = "open array<struct<answer:string,due:long,held:string,early:array<struct<n:long,c:string,e:boolean>>>>"
    return own.withColumn("key", key).groupBy("key").applyInPandasWithState(step, "answer string, number long, text string", open_, "append", "NoTimeout")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What is there now, processed to the end into Parquet files of a shared folder, and those read."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What is there now, processed to the end into a memory table; for tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
