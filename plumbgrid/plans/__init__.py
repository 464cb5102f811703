"""Derived relations and the registered queries; importing the package registers all of them."""

from . import more, pages, queries  # noqa: F401
