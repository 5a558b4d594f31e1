"""Files of data sources in Python: one list of files for each commit, so that what failed tasks leave is never read."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: a dictionary for each file, with its ``name``."""

    files: list[dict]


class Folder:
    """Files under ``path``, in any store that pyarrow reaches; ``_commits`` has a list of files for each write that ended well."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        self.fs.create_dir(self.at(name).rsplit("/", 1)[0], recursive=True)
        return self.fs.open_output_stream(self.at(name))

    def open(self, name: str):
        return self.fs.open_input_file(self.at(name))

    def text(self, name: str) -> str:
        with self.open(name) as f:
            return f.read().decode()

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def commit(self, files: list[dict], replace: bool = False) -> None:
        """Makes ``files`` part of the table, or, with ``replace``, all of it. The list gets its name only when it is whole."""
        old = self.names("_commits")
        made = f"{len(old) and int(old[-1][:12]) + 1:012d}-{uuid.uuid4().hex}{'-all' * replace}"
        with self.create(f"_commits/.{made}") as f:
            f.write(json.dumps(files).encode())
        self.fs.move(self.at(f"_commits/.{made}"), self.at(f"_commits/{made}"))

    def committed(self) -> list[dict]:
        names = [n for n in self.names("_commits") if not n.startswith(".")]
        last = max((k for k, n in enumerate(names) if n.endswith("-all")), default=0)
        return [f for n in names[last:] for f in json.loads(self.text(f"_commits/{n}"))]

    def remove(self, files: list[dict]) -> None:
        for f in files:
            if self.fs.get_file_info(self.at(f["name"])).type == fs.FileType.File:
                self.fs.delete_file(self.at(f["name"]))

    def clean(self, older_than: float = 86400.0) -> list[str]:
        """Deletes files that no list names and that are ``older_than`` seconds old: those of tasks that were killed with their write, or of lost executors."""
        known, gone = {f["name"] for n in self.names("_commits") for f in json.loads(self.text(f"_commits/{n}"))}, []
        for f in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True)):
            name = f.path[len(self.root) :].lstrip("/")
            if f.type == fs.FileType.File and not name.startswith("_commits/") and name not in known and f.mtime.timestamp() <= time.time() - older_than:
                self.fs.delete_file(f.path)
                gone.append(name)
        return gone
