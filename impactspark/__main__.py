import sys

from impactspark.cli import main

sys.exit(main())
