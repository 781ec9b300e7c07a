"""Operators for training data. Nothing outside this subpackage imports it."""

from tidemill.llm.queries import catalog

catalogs = [catalog]
