import sys

from filelens.cli import main

sys.exit(main())
