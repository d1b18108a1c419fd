"""Language adapters: which files a language owns, and which of them are not the repository's own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_lower


@dataclass(frozen=True)
class LanguageAdapter:
    name: str
    extensions: tuple[str, ...]
    markers: tuple[str, ...] = ()


# The built-in languages in order of precedence, their extensions, and path parts of foreign code.
BUILT_IN = (
    LanguageAdapter("python", ("py",), ("/site-packages/", "/.venv/lib/", "/typeshed-fallback/")),
    LanguageAdapter("typescript", ("ts", "tsx"), ("/node_modules/",)),
    LanguageAdapter("rust", ("rs",), ("/target/", "/.cargo/registry/", "/.cargo/git/")),
    LanguageAdapter("go", ("go",), ("/vendor/", "/pkg/mod/")),
)


def custom_adapters(config: dict[str, str], prefix: str = "SORREL") -> tuple[LanguageAdapter, ...]:
    """Adapters from settings: ``<prefix>_CUSTOM_LANGUAGES`` lists tags by comma or white space; for
    each tag, ``<prefix>_LSP_<TAG>_EXTENSIONS`` and ``..._EXTERNAL_MARKERS``. A tag without extensions is dropped."""
    words = lambda key: config.get(f"{prefix}_{key}", "").replace(",", " ").split()
    out = []
    for tag in dict.fromkeys(w.lower() for w in words("CUSTOM_LANGUAGES")):
        if extensions := tuple(e.lstrip(".").lower() for e in words(f"LSP_{tag.upper()}_EXTENSIONS")):
            out.append(LanguageAdapter(tag, extensions, tuple(words(f"LSP_{tag.upper()}_EXTERNAL_MARKERS"))))
    return tuple(out)


def adapter_table(spark: SparkSession, adapters: tuple[LanguageAdapter, ...] = BUILT_IN) -> DataFrame:
    rows = [(i, a.name, list(a.extensions), list(a.markers)) for i, a in enumerate(adapters)]
    return spark.createDataFrame(rows, "priority int, language string, extensions array<string>, markers array<string>")


def route_language(uri: Column, adapters: tuple[LanguageAdapter, ...] = BUILT_IN) -> Column:
    """The language of the first adapter that owns the extension; null where none does."""
    ext = ascii_lower(F.regexp_extract(uri, r"\.([^.]*)$", 1))
    known: dict[str, str] = {}
    for a in adapters:
        for e in a.extensions:
            known.setdefault(e, a.name)
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[ext]


def is_external(uri: Column, root_uri: str, language: Column, adapters: tuple[LanguageAdapter, ...] = BUILT_IN) -> Column:
    """Outside the root, or with a path part that the language's adapter marks as foreign."""
    out = ~uri.startswith(root_uri)
    for a in adapters:
        for marker in a.markers:
            out = out | (language.eqNullSafe(a.name) & uri.contains(marker))
    return out
