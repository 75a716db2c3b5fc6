"""Writing text files below a shared root.

Plans are applied by the tasks that hold their rows.  A file is replaced atomically, and only when
its bytes still hash to ``hash_before``; a repeated or retried task finds the new content in place
and reports it as such.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def apply(plan: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Outcome per plan row (path, hash_before, content): written, done, changed or missing.

    Rows without ``hash_before`` create files and never overwrite a different one.  The write
    happens when the result is computed.
    """

    def digest(data: bytes) -> str:
        return "sha256:" + hashlib.sha256(data).hexdigest()

    def one(path: str, before: str | None, content: str) -> str:
        target = os.path.join(root, path)
        new = content.encode("utf-8")
        current = None
        if os.path.exists(target):
            with open(target, "rb") as f:
                current = digest(f.read())
        if current == digest(new):
            return "done"
        if before is None and current is not None:
            return "changed"
        if before is not None and current is None:
            return "missing"
        if before is not None and current != before:
            return "changed"
        if not dry_run:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.partial-{os.getpid()}"
            with open(partial, "wb") as f:
                f.write(new)
            os.replace(partial, target)
        return "written"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            before = batch["hash_before"].where(batch["hash_before"].notna(), None)
            outcome = [one(p, b, c) for p, b, c in zip(batch["path"], before, batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "outcome": outcome})

    return plan.select("path", "hash_before", "content").mapInPandas(write, "path string, outcome string")
