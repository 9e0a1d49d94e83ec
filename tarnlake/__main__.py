"""``python -m tarnlake COMMAND``: see :mod:`tarnlake.run`."""

from .run import main

raise SystemExit(main())
