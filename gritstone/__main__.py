import sys

from gritstone.cli import main

sys.exit(main())
