import sys

from tracewell.cli import main

sys.exit(main())
