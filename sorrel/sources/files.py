"""Source files: discovery, reading, and line ranges."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.adapters import BUILT_IN, LanguageAdapter, route_language


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(uri, text)`` of all files below a folder, from any store that Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), F.decode("content", "UTF-8").alias("text"))


#: Begins the folder of a rule from above the root; the root's own path as seen from the rule's folder follows.
ABOVE = ">"


def _lines(path: Path) -> list[str]:
    """An ignore file's patterns; a blank at the end counts only behind a backslash."""
    lines = path.read_text(errors="replace").splitlines() if path.is_file() else []
    return [re.sub(r"(?<!\\)\s+$", "", line) for line in lines if line.strip() and not line.startswith("#")]


def global_ignore_file() -> Path:
    """The user's ignore file for all repositories: ``core.excludesFile`` of the user's settings, else the usual place."""
    home = Path.home()
    settings = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / "git"
    for config in (home / ".gitconfig", settings / "config"):
        if config.is_file():
            named = re.findall(r"(?ims)^\[core\](?:(?!^\[).)*?^\s*excludesfile\s*=\s*\"?([^\"\n]+)", config.read_text(errors="replace"))
            if named:
                return Path(named[-1].strip()).expanduser()
    return settings / "ignore"


def ignore_rules(root: str, global_file: Path | str | None = None) -> list[tuple[str, str]]:
    """The ``(folder, pattern)`` pairs of all that has a say below a local root, the weakest first.

    These are the user's global file and the repository's ``info/exclude``, where the root is in a repository, then ``.gitignore`` of the folders between the repository's top and the
    root and of those below it, then ``.ignore`` of the same. Outside a repository, too, ``.gitignore`` files below the root count. ``global_file`` names another global file than the user's.
    """
    top = Path(root).resolve()
    repository = next((p for p in (top, *top.parents) if (p / ".git").exists()), None)
    above = list(reversed(top.parents)) if repository is None else [p for p in reversed(top.parents) if p == repository or repository in p.parents]
    seen_from = lambda folder: f"{ABOVE}{top.relative_to(folder)}" if folder != top else ""
    out = []
    if repository is not None:
        exclude = _lines(repository / ".git" / "info" / "exclude")
        out = [("", line) for line in _lines(Path(global_file) if global_file else global_ignore_file())] + [(seen_from(repository), line) for line in exclude]
    below = [(os.path.relpath(folder, top), Path(folder), names) for folder, _, names in os.walk(top) if {".gitignore", ".ignore"} & set(names)]
    for name in (".gitignore", ".ignore"):
        if repository is not None or name == ".ignore":
            out += [(seen_from(folder), line) for folder in above for line in _lines(folder / name)]
        out += [("" if rel == "." else rel, line) for rel, folder, names in below if name in names for line in _lines(folder / name)]
    return out


@lru_cache(maxsize=4096)
def _glob(pattern: str) -> re.Pattern:
    """An ignore pattern: ``*`` and ``?`` stay within a name, ``**`` as a whole part spans folders, brackets are classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out, i = out + ".+", i + 2
            continue
        close = pattern.find("]", i + 2)
        if c == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "[" + ("^/" + body[1:] if body[0] in "!^" else body) + "]", close + 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return re.compile(out, re.DOTALL)


def ignored(rel: str, rules: list[tuple[str, str]]) -> bool:
    """Whether a path relative to the root is ignored: by the last rule that fits it or a folder above it."""
    parts = rel.split("/")
    for depth in range(1, len(parts) + 1):
        path, verdict = "/".join(parts[:depth]), False
        for folder, rule in rules:
            if folder.startswith(ABOVE):
                under = f"{folder.removeprefix(ABOVE)}/{path}"
            elif folder and not path.startswith(folder + "/"):
                continue
            else:
                under = path[len(folder) + 1 :] if folder else path
            keep, pattern = rule.startswith("!"), rule.removeprefix("!")
            if pattern.endswith("/"):
                if depth == len(parts):
                    continue
                pattern = pattern.rstrip("/")
            # A slash, but for one at the end, ties a pattern to its folder.
            place = under if "/" in pattern else under.rpartition("/")[2]
            if _glob(pattern.removeprefix("/")).fullmatch(place):
                verdict = not keep
        if verdict:
            return True
    return False


def discover(files: DataFrame, root_uri: str, rules: list[tuple[str, str]] = (), adapters: tuple[LanguageAdapter, ...] = BUILT_IN) -> DataFrame:
    """Of ``(uri, ..)`` rows those below the root that a language owns, that are not hidden and not ignored.

    Hidden means a name that begins with a dot, at any depth. The rules are a repository's few ignore lines, applied in Arrow batches.
    """
    under = F.substring(F.col("uri"), len(root_uri.rstrip("/")) + 2, 1 << 20)
    out = files.where(F.col("uri").startswith(root_uri.rstrip("/") + "/") & ~under.rlike(r"(^|/)\.") & route_language(F.col("uri"), adapters).isNotNull())
    if rules:
        held = list(rules)

        @F.pandas_udf("boolean")
        def shown(paths):
            return paths.map(lambda p: not ignored(p, held))

        out = out.where(shown(under))
    return out


def read_range(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Whole lines ``[start_line, end_line)`` of files: ``(uri, start_line, end_line, content, total_lines)``; null bounds are open."""
    start, end = F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(2**31 - 1))
    content, total = T.line_slice(F.col("text"), start, end)
    return requests.join(files.select("uri", "text"), "uri").select("uri", start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), content.alias("content"), total.alias("total_lines"))


def confine(uri: str, root: str) -> Path:
    """The path of a uri, which must lie below the root after links and dots are resolved."""
    path, top = Path(uri.removeprefix("file://")).resolve(), Path(root).resolve()
    if path != top and top not in path.parents:
        raise PermissionError(f"{uri} is not below the root")
    return path
