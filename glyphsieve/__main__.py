from glyphsieve.cli import main

main()
