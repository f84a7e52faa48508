from veridoc.cli import main

raise SystemExit(main())
