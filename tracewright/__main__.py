"""``python -m tracewright``."""

import sys

from tracewright.cli import main

sys.exit(main())
