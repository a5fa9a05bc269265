"""The registered queries. Importing a module of this package registers what it holds."""

from __future__ import annotations

from importlib import import_module

from . import registry

MODULES = ("corpus", "turkish", "vocab", "dataset", "metrics", "vectors", "files", "more", "catalog", "workspace", "tokens", "speech")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)


def flagship(spark, sf_dir: str):
    return all_queries()["word_topk_lang"](spark, sf_dir)
