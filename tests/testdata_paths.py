"""Folders of the given tables; a module of its own name, so that no other conftest hides it."""

SF_SMALL = "/root/testdata/sf0.001"
