import sys

from grainmill.plans.pipeline import main

sys.exit(main(sys.argv[1:]))
