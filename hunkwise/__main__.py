"""``python -m hunkwise``."""

import sys

from hunkwise.cli import main

sys.exit(main())
