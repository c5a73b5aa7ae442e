"""Writing contents as files into a shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def write_files(contents: DataFrame, folder: str) -> None:
    """One file per row (name, content) in ``folder``, a path that all executors reach.

    A file appears at once and whole, under a name that a repeated task writes again. Null contents and names are left out; names lose
    leading slashes and parts that lead out of the folder.
    """

    def run(rows: Iterator[Row]) -> None:
        for name, content in rows:
            parts = [p for p in name.split("/") if p not in ("", ".", "..")]
            if not parts:
                continue
            target = os.path.join(folder, *parts)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, target)

    contents.where("name is not null and content is not null").select("name", "content").foreachPartition(run)
