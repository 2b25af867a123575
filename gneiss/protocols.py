"""What can be plugged in: each a callable or a few of them, given to an operator as an argument."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class Tools(Protocol):
    """gneiss.operators.tools.Corpus is one."""

    def call(self, tool: str, **arguments) -> dict: ...


class Executor(Protocol):
    """gneiss.sources.executor.compiler() gives one, or None."""

    def __call__(self, text: str, inputs: dict | None = None) -> dict: ...


class Scorer(Protocol):
    """Adds score to pairs of texts: for reranking and for entailment."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


class Describer(Protocol):
    """What a query's answer would say; gneiss.functions.text.described is one."""

    def __call__(self, text: Column) -> Column: ...


class Guard(Protocol):
    """The errors of a finding of one class; gneiss.operators.hunts.guard gives one for each."""

    def __call__(self, drift_type: str) -> Column: ...
