from findery.cli import main

raise SystemExit(main())
