import sys

from codeloom.plans.cli import main

sys.exit(main())
