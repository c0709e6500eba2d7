from .project.run import main

main()
