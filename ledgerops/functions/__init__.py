"""Column helpers."""

from ledgerops.functions.scalars import *  # noqa: F401,F403
from ledgerops.functions.times import *  # noqa: F401,F403
