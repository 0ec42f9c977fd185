"""Pass 1: from sources to methods, findings and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tracewell.operators import contract, dataflow, detect, structure


@dataclass
class Analysis:
    """Lazy results over one corpus of sources."""

    files: DataFrame
    methods: DataFrame
    findings: DataFrame
    contract: contract.Contract

    def scores(self, project_type: str = "java-spark") -> DataFrame:
        return contract.scores(self.findings, self.methods, project_type)


def analyse(sources: DataFrame, rules: contract.Contract | None = None) -> Analysis:
    """sources has path and content; a row is a file. No step shuffles the sources."""
    rules = rules or contract.Contract.load()
    files = structure.files(sources)
    methods = dataflow.annotated(detect.detected(structure.methods(files)))
    return Analysis(files, methods, contract.findings(methods, rules), rules)
