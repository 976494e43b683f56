"""Imports every plan module so that the registry is complete."""

from tallyscope.plans import (checks, events, evidence, history, identity, models, panel, ranking,  # noqa: F401
                              sources, streams, text)
from tallyscope.plans.registry import PLANS  # noqa: F401
