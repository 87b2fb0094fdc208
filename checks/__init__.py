"""Registered queries over the given tables, each with its SQL equivalent where one exists."""

from checks import closed_forms, core, decisions, evaluation, files, learning, tuning

REGISTRY = {
    **core.QUERIES,
    **decisions.QUERIES,
    **evaluation.QUERIES,
    **tuning.QUERIES,
    **files.QUERIES,
    **learning.QUERIES,
    **closed_forms.QUERIES,
}
