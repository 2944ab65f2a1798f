"""The entry point without the optional folder."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


class Missing:
    """Finder that knows none of ``names``."""

    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if name in self.names:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.mark.parametrize("names", [("tallyspark.llm",), ("tallyspark.llm", "corpus_pipeline"), ("corpus_pipeline",)])
def test_queries_without_optional_parts(monkeypatch, names):
    for name in list(sys.modules):
        if name.startswith(names):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(*names), *sys.meta_path])
    found, sql = entry._optional()
    if "tallyspark.llm" in names:
        assert not found and not sql
    assert "pipeline" not in found
    importlib.import_module("tallyspark.plans.catalog")


def test_other_import_errors_are_not_hidden(monkeypatch):
    pytest.importorskip("tallyspark.llm")
    monkeypatch.delitem(sys.modules, "tallyspark.llm.queries", raising=False)
    monkeypatch.delitem(sys.modules, "tallyspark.llm.sharding", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing("xxhash"), *sys.meta_path])
    for name in [n for n in sys.modules if n == "xxhash" or n.startswith("xxhash.") or n.startswith("tallyspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        entry._optional()
