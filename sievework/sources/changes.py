"""Changed regions: unified diffs, explicit ranges, and the state of a working tree."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


@dataclass
class Changes:
    """Changed lines per file, and files that are new as a whole. A whole file makes its ranges needless."""

    ranges: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    whole: set[str] = field(default_factory=set)

    def merged(self) -> "Changes":
        return Changes({p: merge(r) for p, r in sorted(self.ranges.items()) if p not in self.whole}, set(self.whole))

    def union(self, other: "Changes") -> "Changes":
        both = {p: [*self.ranges.get(p, []), *other.ranges.get(p, [])] for p in {*self.ranges, *other.ranges}}
        return Changes(both, self.whole | other.whole).merged()

    def tables(self, spark: SparkSession, repo: str = ".") -> tuple[DataFrame, DataFrame]:
        rows = [(repo, p, a, b) for p, ranges in self.ranges.items() for a, b in ranges]
        return spark.createDataFrame(rows, "repo string, file_path string, start int, end int"), spark.createDataFrame([(repo, p) for p in sorted(self.whole)], "repo string, file_path string")


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjacent ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def parse_diff(text: str) -> Changes:
    """Added lines of a unified diff; a new file counts as a whole, a hunk that only removes makes no range."""
    changes, path, new, line = Changes(), None, False, 0
    for raw in text.splitlines():
        if raw.startswith("diff --git "):
            path, new, line = None, False, 0
        elif raw.startswith("--- "):
            new = raw[4:].strip() == "/dev/null"
        elif raw.startswith("+++ "):
            name = raw[4:].split("\t")[0].strip()
            path = None if name == "/dev/null" else re.sub(r"^[ab]/", "", name)
            if path and new:
                changes.whole.add(path)
        elif m := _HUNK.match(raw):
            line = int(m.group(2))
        elif path and line:
            if raw.startswith("+"):
                changes.ranges.setdefault(path, []).append((line, line))
                line += 1
            elif raw.startswith(" "):
                line += 1
    return changes.merged()


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """"N" or "N-M", separated by commas; anything else raises."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m or int(m.group(1)) < 1 or m.group(2) and int(m.group(2)) < int(m.group(1)):
            raise ValueError(f"{part.strip()!r} is no range of lines")
        out.append((int(m.group(1)), int(m.group(2) or m.group(1))))
    return merge(out)


def working_tree(root: str, mode: str = "working-tree") -> Changes:
    """Changes of a git tree: "staged", "unstaged", "working-tree" (both and new files), or a revision to compare with."""
    git = lambda *args: subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout
    if mode == "staged":
        return parse_diff(git("diff", "--unified=0", "--cached"))
    if mode == "unstaged":
        return parse_diff(git("diff", "--unified=0"))
    if mode == "working-tree":
        new = Changes(whole=set(git("ls-files", "--others", "--exclude-standard").splitlines()))
        return parse_diff(git("diff", "--unified=0", "--cached")).union(parse_diff(git("diff", "--unified=0"))).union(new)
    return parse_diff(git("diff", "--unified=0", "--end-of-options", mode))
