"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

from pyspark import TaskContext


def opened(folder: str):
    """(file system, path) of a folder given by path or URI."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def own_file(folder: str, suffix: str):
    """A new file of this task attempt: (stream, path).

    The name holds the attempt, so a task that runs again never touches what an
    earlier attempt wrote. Only what the committed index names is ever read.
    """
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    task = TaskContext.get()
    name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"
    return system.open_output_stream(name, compression=None), name.removeprefix(f"{path}/")


def read_ranges(folder: str, name: str, ranges: list[tuple[int, int]], gap: int = 1 << 16, most: int = 1 << 23):
    """Bytes of each (offset, length), in order of offset.

    Ranges that follow each other within `gap` bytes are read at once, up to
    `most` bytes a read (a longer single range is one read).
    """
    system, path = opened(folder)
    with system.open_input_file(f"{path}/{name}") as file:
        at = 0
        while at < len(ranges):
            begin, end, last = ranges[at][0], sum(ranges[at]), at + 1
            while last < len(ranges) and ranges[last][0] <= end + gap and sum(ranges[last]) - begin <= most:
                end = max(end, sum(ranges[last]))
                last += 1
            data = memoryview(file.read_at(end - begin, begin))
            for offset, length in ranges[at:last]:
                yield data[offset - begin:offset - begin + length]
            at = last
