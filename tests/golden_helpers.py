"""Literals shared by the golden-row tests (a module name of its own: there is a
``conftest`` in more than one folder)."""

import datetime as dt


def ts(text):
    return dt.datetime.fromisoformat(text)
