"""Registered queries, one per operator."""

from __future__ import annotations

import importlib
import os

MODULES = ["vocabulary", "corpus", "chats", "scores", "logs", "problems", "streams"]


def load():
    from tokenloom.catalog import common

    for name in MODULES:
        importlib.import_module(f"tokenloom.catalog.{name}")
    return common.QUERIES, common.ORACLE
