import sys

from recordloom.cli import main

sys.exit(main(sys.argv[1:]))
