"""A streaming source of file changes: listings of a folder compared with the last one.

Spark's own file source only sees new files; this one also reports changes and deletions. With a ``state`` folder a
listing is kept there, under the name that the stream's offset carries; without one it travels in the offset itself, which is for
small trees. Either way nothing is lost or repeated after a restart.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..schemas import CHANGES


def _local(root: str) -> str | None:
    """The plain path of a folder on this machine; None for other stores."""
    scheme = re.match(r"([A-Za-z][\w+.-]*):/*", root)
    if scheme is None:
        return root
    return "/" + root[scheme.end() :] if scheme[1] == "file" else None


def listing(root: str) -> dict[str, list[int]]:
    """{path: [mtime in nanoseconds, size, inode]} of the regular files below a folder; stores without inodes have 0."""
    found = {}
    local = _local(root)
    if local is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            if info.type == fs.FileType.File:
                found[info.path.removeprefix(base).lstrip("/")] = [info.mtime_ns or 0, info.size or 0, 0]
        return found
    for folder, _, names in os.walk(local):
        for name in names:
            full = os.path.join(folder, name)
            try:
                stat = os.stat(full)
            except OSError:
                continue
            found[os.path.relpath(full, local)] = [stat.st_mtime_ns, stat.st_size, stat.st_ino]
    return found


def differences(before: dict, after: dict) -> list[tuple[str, str, str | None]]:
    """(path, change_type, from_path): a path that is gone and a new one with its inode are a rename."""
    gone = {tuple(before[p][1:]): p for p in before if p not in after and before[p][2]}
    out, moved = [], set()
    for path in sorted(after):
        if path not in before:
            old = gone.get(tuple(after[path][1:]))
            if old is not None and old not in moved:
                moved.add(old)
                out.append((path, "renamed", old))
            else:
                out.append((path, "created", None))
        elif before[path] != after[path]:
            out.append((path, "modified", None))
    return out + [(p, "deleted", None) for p in sorted(before) if p not in after and p not in moved]


class _Kept:
    """Listings by name in a state folder, or as they are where there is none."""

    def __init__(self, state: str | None):
        self.state = state

    def _file(self, name: str):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.state if re.match(r"[A-Za-z][\w+.-]*:", self.state) else f"file://{os.path.abspath(self.state)}")
        return store, base, f"{base}/{name}.json"

    def put(self, files: dict) -> str:
        text = json.dumps(files)
        if self.state is None:
            return text
        name = uuid.uuid4().hex
        store, base, path = self._file(name)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(path) as out:
            out.write(text.encode())
        return name

    def get(self, held: str) -> dict:
        if self.state is None or held.startswith("{"):
            return json.loads(held)
        store, _, path = self._file(held)
        with store.open_input_stream(path) as file:
            return json.loads(file.read())

    def forget(self, held: str) -> None:
        if self.state is not None and not held.startswith("{"):
            store, _, path = self._file(held)
            try:
                store.delete_file(path)
            except FileNotFoundError:
                return


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, existing: bool, state: str | None = None):
        self.root, self.existing, self.kept = root, existing, _Kept(state)
        self.done: list[str] = []

    def initialOffset(self) -> dict:
        return {"n": "0", "files": "{}" if self.existing else self.kept.put(listing(self.root))}

    def _rows(self, before: dict, after: dict):
        now = datetime.now(UTC).replace(tzinfo=None)
        return [(p, kind, old, now) for p, kind, old in differences(before, after)]

    def read(self, start: dict):
        after = listing(self.root)
        rows = self._rows(self.kept.get(start["files"]), after)
        if not rows:
            return iter([]), start
        return iter(rows), {"n": str(int(start["n"]) + 1), "files": self.kept.put(after)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(self.kept.get(start["files"]), self.kept.get(end["files"])))

    def commit(self, end: dict) -> None:
        """Listings before the last committed one but one are never asked for again."""
        if not self.done or self.done[-1] != end["files"]:
            self.done.append(end["files"])
        while len(self.done) > 2:
            self.kept.forget(self.done.pop(0))


class ChangeSource(DataSource):
    """``spark.readStream.format("file_changes").option("path", folder)``.

    Option existing=true reports what is there at first; ``state`` names a folder for listings.
    """

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"], self.options.get("existing", "false") == "true", self.options.get("state"))
