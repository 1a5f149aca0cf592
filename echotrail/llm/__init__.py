"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; its queries are listed in
:mod:`echotrail.llm.catalog`.
"""
