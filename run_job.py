"""Script for spark-submit; see spreadloom/plans/job.py for the arguments."""

from spreadloom.plans.job import main

if __name__ == "__main__":
    main()
