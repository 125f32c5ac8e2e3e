"""python -m gristmill"""

import sys

from .cli import main

sys.exit(main())
