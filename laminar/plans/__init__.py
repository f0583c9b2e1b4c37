"""Registered queries."""

from . import coverage as coverage
from . import registry as registry
