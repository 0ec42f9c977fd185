"""The entry point with and without the training-data subpackage."""

import sys

import pytest

import __spark_entry__


class Without:
    """A finder for which one module is not there."""

    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


def hidden(monkeypatch, name):
    for known in [m for m in sys.modules if m == "tracewell.llm" or m.startswith("tracewell.llm.") or m == name]:
        monkeypatch.delitem(sys.modules, known)
    monkeypatch.setattr(sys, "meta_path", [Without(name), *sys.meta_path])


@pytest.mark.parametrize("name", ["tracewell.llm", "tracewell.llm.queries"])
def test_the_rest_works_without_the_subpackage(monkeypatch, name):
    hidden(monkeypatch, name)
    assert "corpus_findings" in __spark_entry__.queries() and "corpus_findings" in __spark_entry__.oracle_sql()
    assert "pipeline" not in __spark_entry__.queries()


def test_a_broken_subpackage_is_an_error(monkeypatch):
    if "pipeline" not in __spark_entry__.queries():
        pytest.skip("the subpackage is not there")
    hidden(monkeypatch, "xxhash")
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
