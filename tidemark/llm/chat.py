"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context and its reply as the
only trainable text.  A turn is written as::

    ### ROLE: TEXT</turn>\\n

and the control strings ``### ``, ``: `` (in roles), ``</turn>`` and the backslash are escaped by a
backslash in front, so that any text is given back as it was.  A conversation that does not end with an
assistant turn also gets its whole transcript as an example without trainable text, so that the output
holds every turn.

Rows are dealt by conversation, sorted by turn, and formatted in one pass that holds one transcript at a
time.  The examples of a conversation of n assistant turns hold n prefixes; that is what the format asks.

Written as files, examples go from a task's Python to Parquet and back a row group at a time, each of
BATCH_CHARS and one transcript at most, so that no wide rows go through the JVM, whose reader and writer
count rows, not bytes.  Every attempt of a task writes a file of its own name, and the manifest, which Spark
commits, names the files that count.  A conversation lies in one file.

Defined cases: conv_id holds whole numbers (other types are refused); a null text or role is empty; a null turn comes first; rows of one turn are ordered by role
and text, and repeated rows are turns of their own; a null conv_id is a conversation of its own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import whole_numbers
from .scratch import stage

TURN, COLON, END = "### ", ": ", "</turn>"
TARGET = "assistant"
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long, final boolean"
SUMMARIES = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
#: Characters of examples that are gathered before they are passed on.
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(TURN, "\\" + TURN).replace(END, "\\" + END)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (found := text.find("\\", at)) >= 0:
        out += (text[at:found], text[found + 1 : found + 2])
        at = found + 2
    return "".join(out) + text[at:]


def _stop(text: str, mark: str, at: int) -> int:
    """Where ``mark`` next stands unescaped."""
    while (found := text.index(mark, at)) >= 0:
        slashes = found
        while slashes > at and text[slashes - 1] == "\\":
            slashes -= 1
        if (found - slashes) % 2 == 0:
            return found
        at = found + 1
    raise ValueError


def parse(transcript: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a transcript, unescaped."""
    at = 0
    while at < len(transcript):
        at += len(TURN)
        role_end = _stop(transcript, COLON, at)
        text_at = role_end + len(COLON)
        text_end = _stop(transcript, END, text_at)
        yield unescape(transcript[at:role_end]), unescape(transcript[text_at:text_end])
        at = text_end + len(END) + 1


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "example", "text", "loss_start", "loss_end", "final"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    ready: list[tuple] = []
    held = 0
    # The example that may be the conversation's last, and the transcript up to now.
    current, number, parts, length, target = object(), 0, [], 0, None

    def close(final: bool) -> None:
        nonlocal held, number
        if target is not None or final:
            text = "".join(parts)
            parts[:] = [text]
            start, end = target or (length, length)
            ready.append((current, number, text, start, end, final))
            number += 1
            held += length

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if conv_id != current:
                if parts:
                    close(True)
                current, number, parts, length, target = conv_id, 0, [], 0, None
            elif target is not None:
                close(False)
            head = f"{TURN}{escape(role or '').replace(COLON, chr(92) + COLON)}{COLON}"
            body = escape(text or "")
            target = (length + len(head), length + len(head) + len(body)) if role == TARGET else None
            parts.append(f"{head}{body}{END}\n")
            length += len(parts[-1])
            if held >= BATCH_CHARS:
                yield _batch(ready, names, kinds)
                ready, held = [], 0
    if parts:
        close(True)
    if ready:
        yield _batch(ready, names, kinds)


def _dealt(turns: DataFrame) -> DataFrame:
    whole_numbers(turns, "conv_id")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text")


def expand(turns: DataFrame) -> DataFrame:
    """Examples of conversations given as rows (conv_id, turn, role, text).

    loss_start and loss_end bound the trainable characters of ``text`` (equal: none); ``final`` marks the
    example that holds the whole conversation.
    """
    return _dealt(turns).mapInArrow(_examples, EXAMPLES)


def write_examples(turns: DataFrame, folder: str) -> DataFrame:
    """Write the examples of `expand` as Parquet files under ``folder`` (a URI); return the staged manifest: part, path and n_examples."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        number, writer, n_examples = TaskContext.get().partitionId(), None, 0
        name = f"{root}/examples-{number:06d}-{uuid.uuid4().hex}.parquet"
        for examples in _examples(batches):
            if writer is None:
                writer = pq.ParquetWriter(name, examples.schema, filesystem=system, compression="zstd", use_dictionary=False, write_statistics=False)
            writer.write_batch(examples)
            n_examples += examples.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([n_examples])], names=["part", "path", "n_examples"])

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    return stage(_dealt(turns).mapInArrow(write, "part int, path string, n_examples long"), "chat-manifest")


def read_summaries(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """What `summarize` gives, from the files that the manifest names, a file a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as source:
                    yield from _summaries(_read_back(_row_groups(source)))

    last = manifest.agg(F.max("part")).first()[0] or 0
    return manifest.repartitionById(last + 1, "part").select("path").mapInArrow(read, SUMMARIES)


def _row_groups(source) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    with pq.ParquetFile(source) as file:
        for k in range(file.num_row_groups):
            yield from file.read_row_group(k, use_threads=False).to_batches()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "example", "loss", "chars", "n_turns", "turns_sha256"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for conv_id, example, text, start, end, final in zip(*(c.to_pylist() for c in batch.columns)):
            n_turns = digest = None
            if final:
                n_turns, sha = 0, hashlib.sha256()
                for role, said in parse(text):
                    n_turns += 1
                    sha.update(f"{role}\n{said}\n".encode())
                digest = sha.hexdigest()
            rows.append((conv_id, example, unescape(text[start:end]), len(text), n_turns, digest))
        if rows:
            yield _batch(rows, names, kinds)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    state: dict | None = None

    def row() -> tuple:
        return (state["conv_id"], state["n_turns"], state["turns"], state["loss"], state["sha"].hexdigest(), state["chars"], state["examples"])

    for batch in batches:
        rows = []
        for conv_id, _, loss, chars, n_turns, turns in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state["conv_id"] != conv_id:
                if state is not None:
                    rows.append(row())
                state = {"conv_id": conv_id, "n_turns": None, "turns": None, "loss": 0, "sha": hashlib.sha256(), "chars": 0, "examples": 0}
            state["loss"] += len(loss)
            state["sha"].update(loss.encode())
            state["chars"] += chars
            state["examples"] += 1
            if turns is not None:
                state["n_turns"], state["turns"] = n_turns, turns
        if rows:
            yield _batch(rows, names, kinds)
    if state is not None:
        yield _batch([row()], names, kinds)


def summarize(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns and trainable text with their digests, characters."""
    read = examples.select("conv_id", "example", "text", "loss_start", "loss_end", "final")
    read = read.mapInArrow(_read_back, "conv_id long, example int, loss string, chars long, n_turns long, turns_sha256 string")
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return dealt.mapInArrow(_summaries, SUMMARIES)
