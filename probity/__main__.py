"""Run the command line."""

import sys

from probity.cli import main

sys.exit(main())
